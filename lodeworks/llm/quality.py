"""Quality classifier: random Fourier features over document statistics.

A Gaussian kernel machine without the kernel matrix: statistics of the whole
text are standardised with moments of the whole corpus, mapped through random
Fourier features and fitted by ridge regression. The normal equations are sums
over rows, so each partition adds up its own and the driver adds the partitions'
(a matrix of fixed size each). They are kept per fold; leaving a fold's sums out
gives the model that has not seen the fold, which serves to choose the penalty
and to calibrate the scores by isotonic regression on out-of-fold scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, lean, materialize, ship

#: Fourier features, folds, and the most labelled rows that are fitted (a fixed sample by hash beyond).
FEATURES, FOLDS, MAX_ROWS = 256, 4, 200_000
#: Partitions of the fitted rows: each sends one matrix for each fold (2 MB in all) to the driver.
PARTS = 8
_GRID = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
_BINS = 2000  # of calibration, over scores from -0.5 to 1.5

_TABLE = np.zeros(256, np.int8)
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b" ", 4), (b"\n", 5), (b"\t\r\x0b\x0c", 4), (b".,;:'\"()-?", 6), (b"!", 7), (b"|", 8), (b"#$%&*@^~=+_<>[]{}\\/`", 9)):
    for _c in _chars:
        _TABLE[_c] = _kind
_KINDS = 10  # 0: everything else, mostly the bytes of other letters

STATISTICS = [f"share_{k}" for k in ("other", "upper", "lower", "digit", "space", "newline", "stop", "bang", "pipe", "symbol")] + [
    "log_bytes", "log_words", "mean_word", "std_word", "long_words", "repeat_next", "repeat_third", "distinct", "top_word", "log_lines", "mean_line", "repeat_line", "upper_words", "symbol_words", "words_with_stop", "entropy",
]


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all finite, also of the empty one."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    kinds = np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=_KINDS) / n
    w = raw.split()
    m = max(len(w), 1)
    sizes = np.fromiter(map(len, w), np.int64, len(w)) if w else np.zeros(1)
    counts = Counter(w)
    times = np.fromiter(counts.values(), np.float64, len(counts)) / m if counts else np.ones(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    upper = sum(c for x, c in counts.items() if len(x) > 1 and x.isupper())
    symbol = sum(c for x, c in counts.items() if x.translate(None, b"#$%&*|@^~=+_<>[]{}\\/`!") != x)
    stop = sum(c for x, c in counts.items() if x[-1:] in b".,;:?!")
    return [
        *kinds,
        log1p(len(raw)),
        log1p(len(w)),
        float(sizes.mean()),
        float(sizes.std()),
        float((sizes > 12).mean()),
        sum(map(eq, w, w[1:])) / m,
        sum(map(eq, w, w[3:])) / m,
        len(counts) / m**0.8,
        float(times.max()),
        log1p(len(lines)),
        log1p(len(raw) / k),
        1 - len(set(lines)) / k,
        upper / m,
        symbol / m,
        stop / m,
        float(-(times * np.log(times)).sum()) / log1p(m),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            x = np.array([statistics(t.as_py()) for t in part.column("text")], np.float32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "key", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (md5 of the text) and x, the statistics, of every document."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    return materialize(src.mapInArrow(lean(_measure), "doc_id long, key string, x array<float>"), "quality-statistics")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class Features:
    """The random map, a function of its seed and the corpus' moments."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, n: int = FEATURES, width: float = 4.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w, self.b = rng.normal(0, 1 / width, (len(mean), n)), rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        out = np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)
        return np.hstack([out, np.ones((len(x), 1))])


def _sums(features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = features.w.shape[1] + 1
        total = np.zeros((FOLDS, d + 1, d + 1))
        for batch in batches:
            x, y, fold = _matrix(batch.column("x")), batch.column("y").to_numpy().astype(float), batch.column("fold").to_numpy()
            for f in range(FOLDS):
                z = np.hstack([features(x[fold == f]), y[fold == f, None]])
                total[f] += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    return run


def _scored(features: Features, models: np.ndarray, carry: list[str], curve: tuple[np.ndarray, np.ndarray] | None = None):
    """carry columns and raw, the linear score (with several models, that of the row's fold), or the calibrated score.

    Between knots the curve is linear; a thousandth of the raw score keeps order on its flat parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                z = features(_matrix(part.column("x")))
                raw = z @ models[0] if len(models) == 1 else (z * models[part.column("fold").to_numpy()]).sum(1)
                if curve:
                    raw = np.clip(np.interp(raw, *curve) * 0.999 + np.clip(raw, 0, 1) * 0.001, 0, 1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(raw)], [*carry, "score" if curve else "raw"])

    return run


def isotonic(centres: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over binned scores; knots of the calibrated curve."""
    blocks: list[list[float]] = []  # sum of centre * count, count, ones
    for c, n, o in zip(centres, counts, ones, strict=True):
        blocks.append([c * n, n, o])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    x, y = np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])
    return x, y


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, key, held_out, score, predicted.

    Labels are learned only from documents whose crc32 of the id as text, modulo
    3, is not 1; of more than ``max_rows`` of them a fixed sample by hash is
    fitted. Statistics, moments and scores cover every document and whole texts;
    the score depends on the text alone.

    Edge cases: null text counts as empty; very long texts are measured whole, one
    at a time; null and repeated ids are scored like others (a label without id is unused, of several labels of one id the mean
    counts); without any label every score is 0.5; empty tables give an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    stats = document_statistics(docs, id_col, text_col)
    n = len(STATISTICS)
    moments = stats.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[i].cast("double")).alias(f"m{i}") for i in range(n)], *[F.stddev_pop(F.col("x")[i].cast("double")).alias(f"s{i}") for i in range(n)]).first()  # one row
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("lid")).agg(F.avg(F.col(label_col).cast("double")).alias("y")).where("y IS NOT NULL").where(crc_fold(F.col("lid")) != 1)
    # the bound holds for the labels, so it is applied to them
    have = known.count()
    if have > max_rows:
        known = known.where(F.pmod(F.xxhash64("lid", F.lit("fit")), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_rows / have)))
    known = materialize(known, "quality-labels")  # max_rows rows but for chance: may be broadcast
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    found = stats.join(F.broadcast(known), F.col("doc_id") == F.col("lid")).select("doc_id", "key", "x", "y", fold.alias("fold"))
    # a bounded number of rows in a few partitions, so as many matrices go to the driver
    train = materialize(found.dropDuplicates(["doc_id", "key"]).select("x", "y", "fold").repartition(PARTS), "quality-train")
    if not moments["n"] or train.isEmpty():
        return stats.select("doc_id", "key", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))

    features = Features(*(np.array([moments[f"{k}{i}"] for i in range(n)], float) for k in "ms"))
    d = FEATURES + 1
    sums = sum(np.frombuffer(r["sums"]).reshape(FOLDS, d + 1, d + 1) for r in train.select("x", "y", "fold").mapInArrow(lean(_sums(features)), "sums binary").collect())  # at most PARTS matrices for each fold
    whole = sums.sum(0)
    rows = whole[d - 1, d - 1]  # the constant feature's sum of squares

    def solve(s: np.ndarray, penalty: float) -> np.ndarray:
        a = s[:d, :d] + penalty * max(s[d - 1, d - 1], 1) / FEATURES * np.diag(np.r_[np.ones(d - 1), 1e-9])
        return np.linalg.solve(a, s[:d, d])

    def out_of_fold(penalty: float) -> float:
        error = 0.0
        for s in sums:
            w = solve(whole - s, penalty)
            error += s[d, d] - 2 * w @ s[:d, d] + w @ s[:d, :d] @ w
        return error

    penalty = min(_GRID, key=out_of_fold) if rows >= 2 * FOLDS else 0.1
    parts = np.array([solve(whole - s, penalty) for s in sums])
    binned = (
        train.mapInArrow(lean(_scored(features, parts, ["y"])), "y double, raw double")
        .groupBy(F.floor((F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) + 0.5) * (_BINS / 2)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
        .orderBy("bin")
        .collect()
    )  # at most _BINS + 1 rows
    # a step of a bin a hundredth as strong as one row, so no end is certain
    x, y = isotonic(*(np.array(v, float) for v in zip(*[((r["bin"] + 0.5) * 2 / _BINS - 0.5, r["n"], r["ones"]) for r in binned], strict=True)))
    model = solve(whole, penalty)
    scored = stats.mapInArrow(lean(_scored(features, model[None], ["doc_id", "key"], (x, y))), "doc_id long, key string, score double")
    return scored.select("doc_id", "key", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents the classifier rejects; every column comes back.

    Edge cases are those of ``quality_scores``: of rows that share an id each is
    judged by its own text; repeated rows go or stay together; columns of docs may
    have any name but those that begin with __lw_.
    """
    rejected = quality_scores(docs, labels, id_col=id_col, text_col=text_col, threshold=threshold).where("predicted = 0").select(F.col("doc_id").alias("__lw_id"), F.col("key").alias("__lw_key")).distinct()
    return docs.join(rejected, docs[id_col].cast("long").eqNullSafe(rejected["__lw_id"]) & (F.md5(F.coalesce(docs[text_col], F.lit(""))) == rejected["__lw_key"]), "left_anti")
