"""Toxicity by weak supervision.

Sixteen voters fire or stay silent on a document: lexicons of insults by topic
and language, patterns of their use, and lexicons of word stems mined from the
labelled documents of the training fold, for insults no list knows. A generative
label model explains how often each combination of voters occurs by a hidden
class: its prior, each voter's rates of firing in either class (its accuracies)
and the annotators' own accuracies, by expectation maximisation. Correlations
that the class does not explain are estimated along the way, and correlated
voters share their weight. The posterior labels train a linear (logistic)
classifier on counts of single terms and stems.

Everything the label model needs is a table of voter combinations: at most 2^16
times three rows, however many documents there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, materialize, ship

#: Labelled documents that the classifier is fitted on (a fixed sample by hash beyond), and stems that are kept.
MAX_ROWS, MAX_STEMS = 20_000, 300
#: So many labels (of 12 bytes) may be broadcast; beyond, the join shuffles.
BROADCAST_LABELS = 1_000_000
#: Lengths of stems, and the most partial counts a worker holds.
_STEM = range(3, 9)
_HELD = 200_000

LEXICONS: dict[str, str] = {
    "mind": "idiot idiots idiotic moron morons moronic stupid stupidity imbecile imbeciles fool fools dumb dumbass dimwit halfwit nitwit cretin simpleton airhead retard retarded brainless",
    "worth": "worthless pathetic loser losers useless trash trashy garbage nobody failure waste pitiful wretched",
    "disgust": "disgusting scum scumbag filth filthy vermin vile revolting repulsive sickening parasite parasites maggot maggots pig pigs rat cockroach subhuman degenerate",
    "ridicule": "clown clowns joke laughable ridiculous buffoon jerk creep weirdo freak freaks coward cowards liar liars hypocrite",
    "profane": "fuck fucking fucked fucker shit shitty bullshit bitch bitches bastard bastards asshole assholes arse arsehole dick dickhead prick cunt whore slut crap damn piss",
    "threat": "kill die murder hang rape shoot stab destroy exterminate hate hates hated",
    "french": "imbécile imbéciles crétin crétine connard connasse salaud salope ordure minable pathétique débile abruti abrutie dégoûtant dégoûtante raclure bouffon merde enculé pute nul nulle idiote stupide",
    "german": "trottel dummkopf arschloch abschaum erbärmlich wertlos wertlose blödmann idioten widerlich versager scheiße hurensohn miststück schwein dreckig ekelhaft schwachkopf vollidiot",
    "spanish": "idiota idiotas estúpido estúpida imbécil basura escoria patético patética inútil perdedor perdedora payaso payasa asqueroso asquerosa mierda puta puto cabrón gilipollas pendejo",
}
#: Words that are insults only in the company of others, or in a threat: they don't fire a voter alone.
WEAK = frozenset("die hang shoot kill destroy hate hates hated rat pig pigs nobody failure waste joke useless damn fool fools nul nulle crap creep freak murder stab inútil ridiculous".split())
TERMS: list[str] = sorted({w for words in LEXICONS.values() for w in words.split()})
_TERMS = frozenset(TERMS)
_STRONG = frozenset(TERMS) - WEAK
_SETS = {k: frozenset(v.split()) for k, v in LEXICONS.items()}
VOTERS = [*LEXICONS, "several", "addressed", "shouted", "disguised", "stem", "stem_twice", "stem_often"]
_LEET = str.maketrans("013457@$!", "oieastasi")
_SPLIT = bytes.maketrans(bytes(range(33)) + b".,;:\"()[]{}<>?!/\\|#%&*+=^~`_-", b" " * 62)
_YOU = frozenset("you your you're youre u ur tu vous du sie ihr tú usted eres".split())


def words_of(text: str | None) -> tuple[str, list[str]]:
    raw = (text or "").encode().translate(_SPLIT).decode()
    return raw, raw.lower().split()


def stem_counts(words: list[str]) -> dict[str, int]:
    """How many words start with each stem."""
    found: dict[str, int] = {}
    for w, n in Counter(words).items():
        for k in _STEM:
            if len(w) < k:
                break
            found[w[:k]] = found.get(w[:k], 0) + n
    return found


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        table = np.array(list(held.values()), np.int64).reshape(-1, 4)
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(table[:, i]) for i in range(4))], ["stem", "t1", "c1", "t2", "c2"])
        held.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            for stem, n in stem_counts(words_of(text.as_py())[1]).items():
                row = held.setdefault(stem, [0, 0, 0, 0])
                row[0 if label else 1] += 1
                if n > 1:
                    row[2 if label else 3] += 1
            if len(held) >= _HELD:
                yield flush()
    yield flush()


def _once(fit: DataFrame) -> DataFrame:
    """One row (text, label) of each text and label: of documents with the same key the one with the smallest id."""
    first = fit.groupBy(F.col("key").alias("fkey"), F.col("label").alias("flabel")).agg(F.min("doc_id").alias("fid"))
    rows = fit.join(first, (F.col("doc_id") == F.col("fid")) & (F.col("key") == F.col("fkey")) & (F.col("label") == F.col("flabel")))
    return materialize(rows.dropDuplicates(["doc_id", "key", "label"]).select("text", "label"), "toxicity-fit")


def mine_stems(fit: DataFrame, most: int = MAX_STEMS) -> dict[str, float]:
    """Stems of toxic documents: stem -> share of toxic ones among the labelled documents that use it.

    Stems rank by how much more often toxic documents have them than clean ones,
    once or at least twice; a longer stem that tells no more than its beginning
    goes.
    """
    sizes = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}  # two rows
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if toxic < 3 or clean < 3:
        return {}
    counted = fit.select("text", "label").mapInArrow(_mine, "stem string, t1 long, c1 long, t2 long, c2 long").groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("t1", "c1", "t2", "c2")])
    gain = F.greatest(F.col("t1") / toxic - F.col("c1") / clean, F.col("t2") / toxic - F.col("c2") / clean)
    strong = ((F.col("t1") >= 3) & (F.col("t1") / toxic >= 10 * (F.col("c1") + 0.5) / clean)) | ((F.col("t2") >= 3) & (F.col("t2") / toxic >= 10 * (F.col("c2") + 0.5) / clean))
    rows = counted.where(strong).withColumn("gain", gain).orderBy(F.desc("gain"), F.length("stem"), "stem").limit(20 * most).collect()
    kept: dict[str, tuple[int, int, int, int]] = {}
    for r in rows:
        now = tuple(r[c] for c in ("t1", "c1", "t2", "c2"))
        begins = [kept[r["stem"][:k]] for k in _STEM if k < len(r["stem"]) and r["stem"][:k] in kept]
        if any(r["c1"] >= 0.5 * b[1] or r["t1"] < 0.3 * b[0] for b in begins):
            continue
        kept[r["stem"]] = now
        if len(kept) == most:
            break
    return {s: max(t1 / (t1 + c1), t2 / max(t2 + c2, 1)) for s, (t1, c1, t2, c2) in kept.items()}


def measure(text: str | None, stems: dict[str, float], starts: frozenset[str]) -> tuple[int, list[str], list[float]]:
    """(mask of voters, terms and stems found, their counts) of a whole text. starts: the stems' first three letters."""
    raw, words = words_of(text)
    counts = Counter(words)
    hit = counts.keys() & _TERMS
    found: dict[str, int] = {}
    disguised = set()
    for w, n in counts.items():
        if w[:3] in starts:
            for k in _STEM:
                if w[:k] in stems and len(w) >= k:
                    found[w[:k]] = found.get(w[:k], 0) + n
        if not w.isalpha() and len(w) > 3 and (plain := w.translate(_LEET)) != w and plain in _STRONG:
            disguised.add(plain)
    if not hit and not disguised and not found:
        return 0, [], []
    strong = hit & _STRONG
    total = sum(counts[w] for w in strong)
    fires = [bool(strong & s) for s in _SETS.values()]
    fires += [total >= 2, False, False, bool(disguised)]
    if strong:
        at = [i for i, w in enumerate(words) if w in strong]
        fires[-3] = any(w in _YOU for i in at for w in words[max(0, i - 4) : i])
        fires[-2] = not raw.isupper() and any(w.upper() in raw for w in strong)
    pure = max((n for s, n in found.items() if stems[s] >= 0.9), default=0)
    mixed = max((n for s, n in found.items() if stems[s] >= 0.5), default=0)
    fires += [pure >= 1, mixed >= 2, mixed >= 4]
    for w in disguised:
        counts[w] += 1
    terms = sorted(hit | disguised)
    own = sorted(found)
    return sum(1 << i for i, f in enumerate(fires) if f), terms + [f"{s}*" for s in own], [float(counts[t]) for t in terms] + [float(found[s]) for s in own]


def _measure(stems: dict[str, float]):
    starts = frozenset(s[:3] for s in stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(t.as_py(), stems, starts) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array([g[2] for g in got], pa.list_(pa.float32()))],
                ["doc_id", "key", "mask", "terms", "counts"],
            )

    return run


def features(masks: np.ndarray, terms: list, counts: list, names: dict[str, int]) -> np.ndarray:
    """Voters, damped counts of terms and stems, damped total of strong terms, a constant."""
    n, v, t = len(masks), len(VOTERS), len(names)
    x = np.zeros((n, v + t + 2), np.float32)
    x[:, :v] = (masks[:, None] >> np.arange(v)) & 1
    for i in range(n):
        if terms[i]:
            c = np.asarray(counts[i])
            x[i, [v + names[w] for w in terms[i]]] = np.log1p(c)
            x[i, v + t] = np.log1p(sum(k for w, k in zip(terms[i], c, strict=True) if w in _STRONG))
    x[:, -1] = 1
    return x


class LabelModel:
    """A two-class model of voters that fire or not, and of a noisy annotator.

    prior: of class 1; rates[c, j]: voter j fires in class c; annotator[c]: labels
    1 in class c; correlation: between voters, beyond what the class explains;
    share: by which a voter's weight is reduced for its correlated company.
    """

    def __init__(self, fires: np.ndarray, label: np.ndarray, count: np.ndarray, steps: int = 60):
        v = fires.shape[1]
        # class 1 starts where any voter fires, unless an annotator objects
        post = np.where(fires.any(1), 0.9, 0.02)
        post = np.where(label == 1, np.maximum(post, 0.8), np.where(label == 0, np.minimum(post, 0.2), post))
        for _ in range(steps):
            w = np.stack([(1 - post) * count, post * count])
            n = w.sum(1)
            self.prior = float(np.clip(n[1] / max(n.sum(), 1), 1e-4, 0.5))
            # a class seen little keeps some doubt; a voter fires more often in class 1 than in class 0
            self.rates = (w @ fires + np.array([[0.05], [1.0]])) / (n[:, None] + np.array([[50.0], [4.0]]))
            self.rates[0] = np.minimum(self.rates[0], self.rates[1] * 0.9)
            known = label >= 0
            self.annotator = (w[:, known] @ (label[known] == 1) + np.array([1.0, 9.0])) / (w[:, known].sum(1) + 10.0)
            self.share = np.ones(v) if _ < steps // 2 else self._shares(fires, w)
            post = self.posterior(fires, label)
        self.correlation = self._residual(fires, np.stack([(1 - post) * count, post * count]))

    def _residual(self, fires: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Correlations of voters inside the classes."""
        cov = np.zeros((fires.shape[1],) * 2)
        for c in range(2):
            if w[c].sum() < 1:
                continue
            d = fires - (w[c] @ fires) / w[c].sum()
            cov += (d * w[c][:, None]).T @ d
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        return cov / np.outer(sd, sd)

    def _shares(self, fires: np.ndarray, w: np.ndarray) -> np.ndarray:
        r = np.clip(self._residual(fires, w), 0, 1)
        return 1 / (1 + np.where(r > 0.3, r, 0).sum(1) - np.diag(np.where(r > 0.3, r, 0)))

    def posterior(self, fires: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        r = np.clip(self.rates, 1e-6, 1 - 1e-6)
        on, off = np.log(r[1] / r[0]) * self.share, np.log((1 - r[1]) / (1 - r[0])) * self.share
        logit = np.log(self.prior / (1 - self.prior)) + fires @ on + (1 - fires) @ off
        if label is not None:
            a = np.clip(self.annotator, 1e-3, 1 - 1e-3)
            logit = logit + np.where(label == 1, np.log(a[1] / a[0]), np.where(label == 0, np.log((1 - a[1]) / (1 - a[0])), 0))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit_logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, penalty: float = 0.02, steps: int = 12) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, penalty * max(weight.sum(), 1) / 100), 1e-6]
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (q - p)) + ridge * w
        h = (x * (weight * np.maximum(q * (1 - q), 1e-5))[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(h, g)
    return w


def _score(model: np.ndarray, names: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = features(part.column("mask").to_numpy(), part.column("terms").to_pylist(), part.column("counts").to_pylist(), names)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(1 / (1 + np.exp(-np.clip(x @ model, -30, 30))), pa.float64())], ["doc_id", "key", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, key, held_out, score, predicted.

    Voter combinations are counted over all documents. Labels are used only of
    documents whose crc32 of the id as text, modulo 3, is not 1: to mine stems
    (from all of them), and as the votes of an annotator whose accuracy is
    estimated. The classifier is fitted on at most ``max_rows`` labelled
    documents, a fixed sample by hash.

    Edge cases: null text counts as empty; very long texts are read whole, one at
    a time; texts in which no voter fires get one
    low score; null and repeated ids are scored like others, a label without id
    is unused, of several labels of one id the mean counts; without labels the
    model is fitted on the voters alone; empty tables give an empty result;
    further columns are ignored.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    known = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("lid"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("y"))
        .where("y IS NOT NULL")
        .where(crc_fold(F.col("lid")) != 1)
        .select("lid", (F.col("y") >= 0.5).cast("int").alias("label"))
    )
    have = known.count()
    part = F.pmod(F.xxhash64("lid", F.lit("fit")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, max_rows / max(have, 1))))
    chosen = materialize(known.where(part), "toxicity-labels")  # max_rows rows but for chance: may be broadcast
    all_known = materialize(known, "toxicity-labels")
    fit = src.join(F.broadcast(all_known) if have <= BROADCAST_LABELS else all_known, F.col("doc_id") == F.col("lid"))
    stems = mine_stems(_once(fit))

    seen = materialize(src.mapInArrow(_measure(stems), "doc_id long, key string, mask int, terms array<string>, counts array<float>"), "toxicity-votes")
    votes = seen.join(known, F.col("doc_id") == F.col("lid"), "left").groupBy("mask", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 * 2^16 rows
    if not votes:
        return seen.select("doc_id", "key", F.lit(False).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    mask, label, n = (np.array([r[k] for r in votes]) for k in ("mask", "label", "n"))
    bits = lambda m: ((m[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    generative = LabelModel(bits(mask), label, n.astype(float))

    # documents without any term are all alike: one row with their weight
    learn = seen.join(F.broadcast(chosen), F.col("doc_id") == F.col("lid"), "inner" if have else "left")
    if not have:  # no labels: a sample of all documents
        learn = learn.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, max_rows / max(n.sum(), 1))))).withColumn("label", F.lit(-1))
    some = F.size("terms") > 0
    # one row of each text: copies must not outweigh the rest
    sample = learn.where(some).groupBy("key", "label").agg(F.any_value("mask").alias("mask"), F.any_value("terms").alias("terms"), F.any_value("counts").alias("counts")).select("mask", "label", "terms", "counts").collect()
    silent = max(learn.where(~some).count(), 1)
    names = {w: i for i, w in enumerate([*TERMS, *(f"{s}*" for s in stems)])}
    masks, given = np.array([r["mask"] for r in sample] + [0]), np.array([r["label"] for r in sample] + [-1])
    x = features(masks, [r["terms"] for r in sample] + [[]], [r["counts"] for r in sample] + [[]], names)
    weight = np.r_[np.ones(len(sample)), silent]
    model = fit_logistic(x, generative.posterior(bits(masks), given), weight / weight.sum() * 1000)
    out = seen.mapInArrow(_score(model, names), "doc_id long, key string, score double")
    return out.select("doc_id", "key", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those predicted toxic; every column comes back.

    Edge cases are those of ``toxicity_scores``: of rows that share an id each is
    judged by its own text; repeated rows go or stay together; columns of docs may
    have any name but those that begin with __lw_.
    """
    bad = toxicity_scores(docs, labels, id_col=id_col, text_col=text_col, threshold=threshold).where("predicted = 1").select(F.col("doc_id").alias("__lw_id"), F.col("key").alias("__lw_key")).distinct()
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["__lw_id"]) & (F.md5(F.coalesce(docs[text_col], F.lit(""))) == bad["__lw_key"]), "left_anti")
