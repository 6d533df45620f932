"""Substring dedup with a log-structured fingerprint index.

Window equality is decided in three steps, each a shuffle by hash that folds
equal keys before it moves them, so a passage that fills a third of the corpus
stays one row per task:

1. Every window of 35 words elects the smallest hash among its 8-word grams
   (its anchor). Equal windows elect equal anchors, and a text has about seven
   anchors per hundred words. Anchors that belong to one text only and occur in
   it once are private: no window that elects them is repeated.
2. The other windows are hashed whole (96 bits, built from two independent
   hash families). A window hash seen at one place only is verified unique.
3. What is left is repeated; the words it covers go.

Equal texts are folded to one row with a count before the second step.

Anchors live in a log-structured index: each batch of texts writes one sorted,
immutable run of (anchor, text key, times, batch), bucketed by anchor. Runs meet
in merge joins on the anchor that move no run (buckets are their partitioning);
many runs are compacted into one. ``substring_dedup`` feeds its table to an index
batch by batch and judges all of it against the merged runs. ``FingerprintIndex``
keeps the index between calls and judges each new batch against what came before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize, new_path, ship
from .hashing import chunks, list_column, mix, ngrams, sliding, to_lists

WINDOW, GRAM = 35, 8
#: Batches in which substring_dedup adds its table to the index, and runs beyond which they are compacted.
BATCHES, FANOUT = 3, 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text).alias("k2"), text.alias("text"))


def _elected(values: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a flat array of several texts' words: gram hashes; for each start the
    elected hash of its window; which starts are windows inside one text."""
    grams = ngrams(values, GRAM)
    elected = sliding(grams, window - GRAM + 1)
    valid = np.zeros(len(values) + 1, np.int32)
    lengths = np.diff(offsets)
    full = lengths >= window
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[1:][full] - window + 1, -1)
    return grams, elected, np.cumsum(valid)[: len(elected)].astype(bool)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen = window - GRAM + 1, set()  # copies of a text count once in a task
        for batch in batches:
            fresh = []
            for i, key in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            k1, k2 = (batch.column(i).to_numpy() for i in range(2))
            flat, off = list_column(batch, "wh")
            for i, j in chunks(off):
                o = off[i : j + 1] - off[i]
                grams, elected, valid = _elected(flat[off[i] : off[j]], o, window)
                if not valid.any():
                    continue
                # a gram is an anchor if a window that holds it elects its value
                best = np.concatenate([np.zeros(w - 1, np.uint64), np.where(valid, elected, np.uint64(0)), np.zeros(w - 1, np.uint64)])
                at = np.flatnonzero(sliding(best, w, np.maximum)[: len(grams)] == grams)
                doc, value = np.searchsorted(o, at, side="right") - 1, grams[at]
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
                times = np.diff(np.r_[first, len(doc)])
                d = doc[first] + i
                yield pa.RecordBatch.from_arrays([pa.array(value[first].view(np.int64)), pa.array(k1[d]), pa.array(k2[d]), pa.array(np.minimum(times, 2).astype(np.int8))], ["hash", "k1", "k2", "times"])

    return run


def anchor_postings(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Anchors of each text, once in a task: hash, k1, k2, times (in the text; 2 for more)."""
    wh = keyed.select("k1", "k2", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh"))
    return wh.mapInArrow(_anchors(window), "hash long, k1 long, k2 long, times byte")


_CANDIDATES = "rid long, k1 long, k2 long, mult long, new boolean, n_words int, whole_sha string, text string, starts array<int>, ends array<int>"


def _candidates(window: int):
    """Per text: the ranges of windows whose anchor isn't private; the text only where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            flat, off = list_column(batch, "wh")
            pflat, poff = list_column(batch, "private")
            starts, ends, counts = [], [], np.zeros(batch.num_rows, np.int32)
            for i, j in chunks(off):
                o = off[i : j + 1] - off[i]
                _, elected, valid = _elected(flat[off[i] : off[j]], o, window)
                if not valid.any():
                    continue
                docs = np.repeat(np.arange(j - i), np.diff(o))[: len(elected)].astype(np.uint64)
                change = np.flatnonzero(np.r_[True, (elected[1:] != elected[:-1]) | (docs[1:] != docs[:-1])])
                pd = np.repeat(np.arange(j - i), np.diff(poff[i : j + 1])).astype(np.uint64)
                private = np.isin(mix(elected[change] + mix(docs[change] + np.uint64(1))), mix(pflat[poff[i] : poff[j]] + mix(pd + np.uint64(1))))
                open_ = valid & ~np.repeat(private, np.diff(np.r_[change, len(elected)]))
                edge = np.flatnonzero(np.r_[open_[:1], (open_[1:] != open_[:-1]) | (open_[1:] & (docs[1:] != docs[:-1]))])
                edge_on = edge[open_[edge]]
                if not len(edge_on):
                    continue
                nxt = np.r_[edge, len(open_)]
                end = nxt[np.searchsorted(nxt, edge_on, side="right")]
                d = docs[edge_on].astype(np.int64)
                starts.append((edge_on - o[d]).astype(np.int32))
                ends.append((end - o[d]).astype(np.int32))
                counts[i:j] += np.bincount(d, minlength=j - i).astype(np.int32)
            rid = (np.int64(part) << 33) + np.arange(row, row + batch.num_rows, dtype=np.int64)
            row += batch.num_rows
            text = pa.array(np.where(counts > 0, batch.column("text").to_numpy(zero_copy_only=False), None), pa.string())
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), *(batch.column(c) for c in ("k1", "k2", "mult", "new")), pa.array(np.diff(off).astype(np.int32)), batch.column("whole_sha"), text, to_lists(cat(starts), counts, pa.int32()), to_lists(cat(ends), counts, pa.int32())],
                ["rid", "k1", "k2", "mult", "new", "n_words", "whole_sha", "text", "starts", "ends"],
            )

    return run


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    return np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _windows(window: int):
    """Per candidate window: two hashes, and its place (text, word) as lowest and highest; a text that stands for several counts as two places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, many = batch.column("rid").to_numpy(), batch.column("mult").to_numpy() > 1
            flat, off = list_column(batch, "wh")
            (s, so), (e, _) = list_column(batch, "starts", np.int32), list_column(batch, "ends", np.int32)
            for i, j in chunks(off):
                v = flat[off[i] : off[j]]
                row = np.repeat(np.arange(i, j), np.diff(so[i : j + 1]))
                base = off[row] - off[i]
                a, b = s[so[i] : so[j]].astype(np.int64), e[so[i] : so[j]].astype(np.int64)
                at = _ranges(a + base, b + base)
                if not len(at):
                    continue
                rows = np.repeat(row, b - a)
                place = (at - (off[rows] - off[i])).astype(np.int32)
                h, c = ngrams(v, window)[at], ngrams(v, window, salt=0x5BD1E995)[at]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((c >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(rid[rows]), pa.array(rid[rows]), pa.array(place), pa.array(place + many[rows].astype(np.int32))], ["h", "c", "lo", "hi", "first", "last"])

    return run


_REMOVED = "k1 long, k2 long, n_words long, n_removed long, kept string"


def _removed(window: int):
    """Per candidate text: the words left when all that repeated windows cover are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (s, so), (e, _), (u, uo) = (list_column(batch, c, np.int32) for c in ("starts", "ends", "unique"))
            texts, many = batch.column("text"), batch.column("mult").to_numpy() > 1
            n_words, gone, kept = batch.column("n_words").to_numpy(), [], []
            for i in range(batch.num_rows):
                n = int(n_words[i])
                if many[i]:  # the text as a whole stands elsewhere too
                    cover = np.full(n, n >= window)
                else:
                    open_ = _ranges(s[so[i] : so[i + 1]].astype(np.int64), e[so[i] : so[i + 1]].astype(np.int64))
                    open_ = np.setdiff1d(open_, u[uo[i] : uo[i + 1]], assume_unique=True)
                    edge = np.zeros(n + 1, np.int32)
                    edge[open_] += 1
                    np.subtract.at(edge, open_ + window, 1)
                    cover = np.cumsum(edge)[:n] > 0
                gone.append(int(cover.sum()))
                w = texts[i].as_py().encode().split()  # bytes.split() parts at \x20 \x09-\x0D
                kept.append(b" ".join([w[k] for k in np.flatnonzero(~cover)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(n_words.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["k1", "k2", "n_words", "n_removed", "kept"])

    return run


def _judge(keyed: DataFrame, merged: DataFrame, window: int, history: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """k1, k2, n_words, n_removed, kept_sha256, kept (null: all words) per distinct text of keyed.

    merged: the anchors of keyed, and of the index where they occur there, folded
    (see ``_folded``). history: what the index has of those anchors (hash, k1, k2)
    and its texts.
    """
    texts = keyed.groupBy("k1", "k2").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("mult")).withColumn("new", F.lit(True))
    own = merged.where("lo = hi AND times = 1").select(F.col("lo").alias("p1"), "p2", "hash")
    if history:
        shared, old_texts = history
        known = keyed.select("k1", "k2").distinct()
        # a text that the index has too counts once more; other texts of the index lend their windows
        same = old_texts.select(F.col("k1").alias("o1"), F.col("k2").alias("o2")).distinct()
        texts = texts.join(same, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")), "left").withColumn("mult", F.when(F.col("o1").isNull(), F.col("mult")).otherwise(F.col("mult") + 1)).drop("o1", "o2")
        touched = shared.select("k1", "k2").distinct().join(known, ["k1", "k2"], "left_anti")
        lent = old_texts.join(touched, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("mult"))
        texts = texts.unionByName(lent.withColumn("new", F.lit(False)))
    private = own.groupBy("p1", "p2").agg(F.collect_list("hash").alias("private"))
    w = words(F.col("text"))
    joined = texts.join(private, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")), "left").select(
        "k1",
        "k2",
        "mult",
        "new",
        F.sha2(F.array_join(w, " "), 256).alias("whole_sha"),
        "text",
        F.transform(w, lambda x: F.xxhash64(x)).alias("wh"),
        F.coalesce("private", F.array().cast("array<bigint>")).alias("private"),
    )
    texts = materialize(joined.mapInArrow(_candidates(window), _CANDIDATES), "substring-texts")
    open_ = texts.where("text IS NOT NULL")
    places = (
        open_.select("rid", "mult", "starts", "ends", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("wh"))
        .mapInArrow(_windows(window), "h long, c int, lo long, hi long, first int, last int")
        .groupBy("h", "c")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last"))
        .where("lo = hi AND first = last")
    )
    unique = places.groupBy(F.col("lo").alias("urid")).agg(F.collect_list("first").alias("unique"))
    # where the windows' anchors are private, only copies of the whole text can repeat them
    decided = open_.where("new").join(unique, F.col("rid") == F.col("urid"), "left").select("k1", "k2", "mult", "n_words", "text", "starts", "ends", F.coalesce("unique", F.array().cast("array<int>")).alias("unique"))
    cut = decided.mapInArrow(_removed(window), _REMOVED).select("k1", "k2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "kept")
    all_gone = (F.col("mult") > 1) & (F.col("n_words") >= window)
    rest = texts.where("text IS NULL AND new").select(
        "k1",
        "k2",
        F.col("n_words").cast("long").alias("n_words"),
        F.when(all_gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.col("whole_sha")).alias("kept_sha256"),
        F.when(all_gone, F.lit("")).alias("kept"),
    )
    return cut.unionByName(rest)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Words are runs of anything but ASCII white space. Every word covered by a
    window of ``window`` consecutive words whose sequence also starts anywhere
    else in docs, the same document included, is removed, in all its places. The
    number of batches in which the table goes to the index doesn't matter for it.

    Edge cases: null and empty texts have no words; very long texts are hashed in
    parts and have no limit but Spark's own of 2^31 array elements; texts of fewer than
    ``window`` words lose nothing; repeated rows are copies of each other; null
    ids work like others; an empty table gives an empty result; further columns
    are ignored.
    """
    keyed = _keyed(docs, id_col, text_col)
    index = _Runs(docs.sparkSession, new_path(docs.sparkSession, "fingerprints"))
    for i in range(batches):
        part = keyed.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i) if batches > 1 else keyed
        index.write(i, anchor_postings(part, window))
    if len(index.spans()) > FANOUT:
        index.compact()
    judged = _judge(keyed, index.merged(), window).drop("kept")
    rows = keyed.select("doc_id", F.col("k1").alias("d1"), F.col("k2").alias("d2"))
    return rows.join(judged, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _folded(run: DataFrame) -> DataFrame:
    """A row for each anchor: whether one text has it (lo = hi), that text's key (lo, p2), and how often."""
    return run.groupBy("hash").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.min("k2").alias("p2"), F.max("times").alias("times"))


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two folded runs as one, by a merge join on the anchor."""
    a, b = (x.toDF(*[f"{n}_{c}" for c in ("hash", "lo", "hi", "p2", "times")]) for n, x in (("a", a), ("b", b)))
    both = a.join(b, F.col("a_hash") == F.col("b_hash"), "full")
    return both.select(F.coalesce("a_hash", "b_hash").alias("hash"), F.least("a_lo", "b_lo").alias("lo"), F.greatest("a_hi", "b_hi").alias("hi"), F.least("a_p2", "b_p2").alias("p2"), F.greatest("a_times", "b_times").alias("times"))


class _Runs:
    """Sorted immutable runs of anchors under path/<first batch>_<last batch>, each one bucketed Parquet table.

    A run is there once Spark has written its _SUCCESS file. Compaction writes
    the run of all batches before it deletes their own; runs inside the span of
    another one are not read.
    """

    SCHEMA = "hash long, k1 long, k2 long, times byte, batch int"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        p, fs = self.fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def there(self, path: str) -> bool:
        p, fs = self.fs(path)
        return fs.exists(p)

    def drop(self, path: str) -> None:
        p, fs = self.fs(path)
        fs.delete(p, True)

    def spans(self) -> list[tuple[int, int]]:
        """Batches of the runs to read."""
        done = [tuple(map(int, n.split("_"))) for n in self.names(self.path) if self.there(f"{self.path}/{n}/_SUCCESS")]
        return sorted(s for s in done if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in done))

    def _at(self, span: tuple[int, int]) -> str:
        return f"{self.path}/{span[0]:09d}_{span[1]:09d}"

    def write(self, batch: int, postings: DataFrame) -> None:
        rows = postings.repartition(self.buckets, "hash").groupBy("hash", "k1", "k2").agg(F.max("times").alias("times"))
        self._save(rows.withColumn("batch", F.lit(batch)), (batch, batch))

    def _save(self, rows: DataFrame, span: tuple[int, int]) -> None:
        name = f"lodeworks_{uuid4().hex}"  # a bucketed write needs a table's name, for its time only
        rows.write.format("parquet").option("compression", "zstd").option("path", self._at(span)).bucketBy(self.buckets, "hash").sortBy("hash").mode("overwrite").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def read(self, span: tuple[int, int]) -> DataFrame:
        """A run, in its buckets."""
        name = f"lodeworks_{uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self._at(span)}'")
        try:
            return self.spark.table(name).select("hash", "k1", "k2", "times", "batch")
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def merged(self) -> DataFrame:
        """All runs, folded and merge-joined."""
        return reduce(_merge, [_folded(self.read(s)) for s in self.spans()])

    def compact(self) -> None:
        """One run of all."""
        spans = self.spans()
        if len(spans) > 1:
            every = reduce(DataFrame.unionByName, [self.read(s) for s in spans])
            self._save(every.repartition(self.buckets, "hash"), (spans[0][0], spans[-1][1]))
        for name in self.names(self.path):
            if tuple(map(int, name.split("_"))) not in self.spans():
                self.drop(f"{self.path}/{name}")


class FingerprintIndex:
    """Incremental substring dedup against everything added before.

    ``path`` is a folder in a store all executors share. Batch n writes texts/<n>
    (its distinct texts) and a run of its anchors, then the marker commits/<n>: a
    batch counts once the marker is there, so a job that died leaves nothing that
    is read, and adding n again goes on from there. Batches are numbered upwards
    by the caller. The number of buckets stays as it was when the index began.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.window, self.fanout = spark, path.rstrip("/"), window, fanout
        self._runs = _Runs(spark, f"{self.path}/runs", buckets)
        made = [n for n in self._runs.names(f"{self.path}/buckets") if n.isdigit()]
        self._runs.buckets = int(made[0]) if made else self._runs.buckets
        if not made:
            self._touch(f"buckets/{self._runs.buckets}")

    def _touch(self, name: str) -> None:
        p, fs = self._runs.fs(f"{self.path}/{name}")
        fs.mkdirs(p)

    def committed(self) -> list[int]:
        return [int(n) for n in self._runs.names(f"{self.path}/commits") if n.isdigit()]

    def runs(self) -> list[tuple[int, int]]:
        """First and last batch of each run."""
        done = set(self.committed())
        return [s for s in self._runs.spans() if s[0] != s[1] or s[0] in done]

    def add(self, docs: DataFrame, batch: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch (the next one, if no number is given) and judge it against itself and the batches of lower numbers.

        Returns doc_id, n_words, n_removed, kept_sha256, kept_text (null: unchanged).
        Edge cases are those of ``substring_dedup``.
        """
        done = self.committed()
        batch = max(done, default=-1) + 1 if batch is None else batch
        keyed = materialize(_keyed(docs, id_col, text_col), "substring-batch")
        if batch not in done:
            if done and batch < max(done):
                raise ValueError(f"batch {batch} comes after {max(done)}, which has been added")
            keyed.groupBy("k1", "k2").agg(F.any_value("text").alias("text")).write.mode("overwrite").parquet(f"{self.path}/texts/{batch:09d}")
            self._runs.write(batch, anchor_postings(keyed, self.window))
            self._touch(f"commits/{batch:09d}")
        before = [n for n in done if n < batch]
        mine = next(self._runs.read(s) for s in self.runs() if s[0] <= batch <= s[1]).where(F.col("batch") == batch)
        merged, history = _folded(mine), None
        if before:
            old = reduce(DataFrame.unionByName, [self._runs.read(s).where(F.col("batch") < batch).join(mine.select("hash").distinct(), "hash", "left_semi") for s in self.runs() if s[0] < batch])
            shared = materialize(old.select("hash", "k1", "k2", "times"), "substring-shared")
            merged = _merge(merged, _folded(shared))
            history = shared, self.spark.read.parquet(*[f"{self.path}/texts/{n:09d}" for n in before])
        judged = materialize(_judge(keyed, merged, self.window, history), "substring-judged")
        if len(self.runs()) > self.fanout:
            self.compact()
        rows = keyed.select("doc_id", F.col("k1").alias("d1"), F.col("k2").alias("d2"))
        return rows.join(judged, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("kept").alias("kept_text"))

    def compact(self) -> None:
        """Merge all runs into one, written before the old ones go."""
        done = set(self.committed())
        for s in self._runs.spans():
            if s[0] == s[1] and s[0] not in done:  # left by a job that died
                self._runs.drop(self._runs._at(s))
        self._runs.compact()
