"""Near-duplicate detection: ProbMinHash signatures, banding, verification, classes.

Shingles are five consecutive words (a text of one to four words is one
shingle), weighted by how often they occur in the text. Each shingle emits a
Poisson process of arrivals at a rate equal to its weight; every arrival falls
into a random register, and a register keeps its earliest. A shingle stops
emitting when its next arrival is later than all the text's registers, so nearly
all shingles of an ordinary text emit once. Two texts agree in a register with
probability equal to their probability Jaccard similarity.

A text with repeated shingles gets a second signature, of its distinct shingles,
whose registers agree with probability plain Jaccard; for other texts both are
the same. Registers are hashed in bands; texts that share a band are candidates,
and every pair that counts is verified on its full shingle sets.

Candidates are settled in two steps, neither of which drops any:

1. Inside a bucket all texts meet one leader: n - 1 comparisons for n texts.
   What they link is merged to classes.
2. The texts of all buckets that still hold several classes are joined once by
   prefix: with shingles ordered from rare to frequent, two texts at 0.8 share
   one among the first fifth (by number or by weight) of each. Of two texts that
   meet at a shingle, what is left of both from there on bounds their similarity,
   and so does the number of bits in which their parity maps differ (bit i says
   whether an odd number of a text's shingles hash to i): texts differ in as many
   shingles at least. Only pairs of different classes whose bounds reach 0.8 are
   verified. Texts
   whose own shingles make up a fifth meet nobody at all, so a template that
   thousands of texts fill differently costs their number, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, lean, materialize, ship, small
from .hashing import chunks, list_column, mix, ngrams, pair, to_lists

SHINGLE, SIMILARITY = 5, 0.8
#: 20 bands of 4 registers: a pair at 0.8 shares a band with probability 0.99997, one at 0.5 with 0.72, one at 0.2 with 0.03.
BANDS, ROWS = 20, 4
#: So many candidate keys (three longs each) may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
#: Texts of a prefix group in one block, and members that meet a leader in one task.
GROUP_BLOCK, BLOCK = 256, 128
#: Longs of a text's parity map.
MAP = 8
_EPS = 1e-9


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(flat: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle of each row of a flat array of word hashes; rows ascending."""
    lengths = np.diff(offsets)
    n = np.maximum(lengths - size + 1, 0)
    rows = np.repeat(np.arange(len(lengths)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    got = ngrams(flat, size)[at] if len(at) else flat[:0]
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        extra = np.array([ngrams(flat[offsets[i] : offsets[i + 1]], int(lengths[i]))[0] for i in short], np.uint64)
        rows, got = np.r_[rows, short], np.r_[got, extra]
        order = np.argsort(rows, kind="stable")
        rows, got = rows[order], got[order]
    return rows, got


def weighted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) and how often they occur, sorted."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])])
    return rows[first], hashes[first], np.diff(np.r_[first, len(rows)])


def prob_minhash(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """n_rows x registers: the hash of the shingle whose arrival each register keeps; 0 for rows without shingles."""
    earliest, kept = np.full(n_rows * registers, np.inf), np.zeros(n_rows * registers, np.uint64)
    time = np.zeros(len(rows))
    step = 0
    while len(rows):
        step += 1
        r = mix(hashes + np.uint64((step * 0x9E3779B97F4A7C15) % 2**64))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weights
        slot = rows * registers + (mix(r + np.uint64(0x632BE59BD9B4E019)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = time == earliest[slot]
        kept[slot[won]] = hashes[won]
        on = time < earliest.reshape(n_rows, registers).max(1)[rows]
        rows, hashes, weights, time = rows[on], hashes[on], weights[on], time[on]
    return kept.reshape(n_rows, registers)


def _banded(bands: int, per_band: int):
    def keys(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        sig = prob_minhash(rows, hashes, weights, n, bands * per_band).reshape(-1, bands, per_band)
        out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), sig.shape[:2])
        for k in range(per_band):
            out = pair(out, sig[:, :, k])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = list_column(batch, "wh")
            for i, j in chunks(off):
                o = off[i : j + 1] - off[i]
                rows, got, times = weighted(*shingle_hashes(flat[off[i] : off[j]], o))
                full = np.diff(o) > 0
                out = keys(rows, got, times.astype(np.float64), j - i)
                heavy = np.zeros(j - i, bool)
                heavy[rows[times > 1]] = True
                again, on = np.flatnonzero(heavy), heavy[rows]
                out = np.concatenate([out, out])
                if len(again):
                    out[j - i + again] = keys(np.searchsorted(again, rows[on]), got[on], np.ones(on.sum()), len(again))
                # by text: its weighted keys, then, if a shingle repeats, those of its distinct shingles
                out = out.reshape(2, j - i, bands).transpose(1, 0, 2)[np.stack([full, heavy], 1)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k1", "k2")), to_lists(out.ravel().view(np.int64), bands * (full.astype(int) + heavy), pa.int64())], ["doc_id", "k1", "k2", "bands"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of plain and probability Jaccard of two weighted shingle sets (sorted distinct hashes, counts)."""
    (x, v), (y, w) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    common = int(both.sum())
    plain = common / (len(x) + len(y) - common)
    if not common or (v.max() == 1 and w.max() == 1):
        return plain
    # J_P = sum over common d of 1 / sum over e of max(v_e / v_d, w_e / w_d): sort e by v_e / w_e
    wy = np.zeros(len(x))
    wy[both] = w[at[both]]
    only_y = np.ones(len(y), bool)
    only_y[at[both]] = False
    ve, we = np.r_[v, np.zeros(only_y.sum())], np.r_[wy, w[only_y]]
    ratio = np.where(we > 0, ve / np.maximum(we, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, ve, we = ratio[order], ve[order], we[order]
    v_from, w_upto = np.r_[np.cumsum(ve[::-1])[::-1], 0.0], np.r_[0.0, np.cumsum(we)]
    vd, wd = v[both].astype(float), w[at[both]].astype(float)
    k = np.searchsorted(ratio, vd / wd, side="left")
    return max(plain, float((1.0 / (v_from[k] / vd + w_upto[k] / wd)).sum()))


def _sides(batch: pa.RecordBatch, i: int, j: int, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted shingles of rows i to j: hashes, counts, where each row's begin, and which rows repeat one."""
    rows, got, times = weighted(*shingle_hashes(flat[off[i] : off[j]], off[i : j + 1] - off[i]))
    heavy = np.zeros(j - i, bool)
    heavy[rows[times > 1]] = True
    return got, times, np.searchsorted(rows, np.arange(j - i + 1)), heavy


def _verify(least: float):
    """Rows sorted by group (a, block), leader first: (a, b) of members as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            a, b, block = (batch.column(c).to_numpy() for c in ("a", "id", "block"))
            flat, off = list_column(batch, "wh")
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in chunks(off):
                got, times, ends, heavy = _sides(batch, i, j, flat, off)
                cut = np.flatnonzero((np.diff(a[i:j]) != 0) | (np.diff(block[i:j]) != 0)) + 1
                for s, e in zip([0, *cut.tolist()], [*cut.tolist(), j - i]):
                    if a[i + s] == b[i + s]:
                        x, y = ends[s : s + 2]
                        key, own, s = (a[i + s], block[i + s]), (got[x:y], times[x:y], heavy[s]), s + 1
                    if s == e:
                        continue
                    assert key == (a[i + s], block[i + s])
                    out.append((np.full(e - s, key[0]), b[i + s : i + e], _alike(own, got, times, ends[s : e + 1], heavy[s:e], least)))
            first, second, similar = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.int64, bool)))
            yield pa.RecordBatch.from_arrays([pa.array(first[similar]), pa.array(second[similar])], ["a", "b"])

    return run


def _alike(own: tuple, hashes: np.ndarray, counts: np.ndarray, ends: np.ndarray, heavy: np.ndarray, least: float) -> np.ndarray:
    """Which of several texts, whose shingles lie between ends, are similar to one."""
    x, v, is_heavy = own
    sizes = np.diff(ends)
    if not len(x):
        return np.zeros(len(sizes), bool)
    part, n = hashes[ends[0] : ends[-1]], np.repeat(np.arange(len(sizes)), sizes)
    hit = x[np.minimum(np.searchsorted(x, part), len(x) - 1)] == part
    common = np.bincount(n, hit, len(sizes))
    found = common >= least * (len(x) + sizes - common) - _EPS
    for k in np.flatnonzero(~found & (common > 0) & (heavy | is_heavy)):  # plain Jaccard doesn't say
        found[k] = similarity((x, v), (hashes[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]])) >= least
    return found


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of pairs(a, b, block) that are similar, as (a, b). The text of a goes once to each of its blocks."""
    need = pairs.select("a", "block", F.col("b").alias("id")).unionByName(pairs.select("a", "block").distinct().withColumn("id", F.col("a")))
    rows = need.join(texts, F.col("id") == F.col("tid")).select("a", "block", "id", "text")
    sides = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("id") != F.col("a"))
    return sides.select("a", "block", "id", word_hashes(F.col("text")).alias("wh")).mapInArrow(lean(_verify(least)), "a long, b long")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct shingle of each text: sh, tid, times, and of the text n (distinct ones) and total."""
    for batch in batches:
        tid = batch.column("tid").to_numpy()
        flat, off = list_column(batch, "wh")
        for i, j in chunks(off):
            rows, got, times = weighted(*shingle_hashes(flat[off[i] : off[j]], off[i : j + 1] - off[i]))
            n, total = np.bincount(rows, minlength=j - i), np.bincount(rows, times, j - i).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(tid[i:j][rows]), pa.array(times.astype(np.int32)), pa.array(n[rows].astype(np.int32)), pa.array(total[rows].astype(np.int32))], ["sh", "tid", "times", "n", "total"])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mtid and the parity map of the distinct shingles of each text."""
    for batch in batches:
        tid = batch.column("tid").to_numpy()
        flat, off = list_column(batch, "wh")
        for i, j in chunks(off):
            rows, got, _ = weighted(*shingle_hashes(flat[off[i] : off[j]], off[i : j + 1] - off[i]))
            bit = (mix(got) % np.uint64(64 * MAP)).astype(np.int64)
            odd = np.bincount(rows * 64 * MAP + bit, minlength=(j - i) * 64 * MAP).astype(np.uint8) & 1
            bits = np.packbits(odd).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tid[i:j]), to_lists(bits, np.full(j - i, MAP), pa.int64())], ["mtid", "map"])


def _prefixes(least: float):
    """Per text with its shared shingles in order: those in its prefix, with what is left of the text from there on.

    rem counts distinct shingles, mass is their share of the text's weight. The
    shingles no other text has come before all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, n, total = (batch.column(c).to_numpy() for c in ("tid", "n", "total"))
            (sh, off), (times, _), (maps, _) = list_column(batch, "sh"), list_column(batch, "times", np.int32), list_column(batch, "map", np.int64)
            size = np.diff(off)
            row = np.repeat(np.arange(len(tid)), size)
            rem = np.repeat(off[1:], size) - np.arange(len(sh))
            upto = np.r_[0, np.cumsum(times, dtype=np.int64)]
            mass = (upto[np.repeat(off[1:], size)] - upto[:-1]) / total[row]
            on = (rem >= least * n[row] - _EPS) | (mass >= least - _EPS)
            row = row[on]
            yield pa.RecordBatch.from_arrays([pa.array(sh[on].view(np.int64)), pa.array(tid[row]), pa.array(n[row]), pa.array(rem[on].astype(np.int32)), pa.array(mass[on]), pa.array(total[row] > n[row]), to_lists(maps.reshape(-1, MAP)[row].ravel(), np.full(len(row), MAP), pa.int64())], ["sh", "tid", "n", "rem", "mass", "heavy", "map"])

    return run


def _met(least: float, one: bool):
    """Rows sorted by (sh, p, q): pairs of different classes whose bound reaches least. one: of any two
    classes that have several texts in the group, the pair of the highest bound only."""

    def group(tid, label, side, n, rem, mass, heavy, maps) -> tuple[np.ndarray, ...]:
        x, y = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        apart = label[x][:, None] != label[y]
        if one:
            _, of, size = np.unique(label, return_inverse=True, return_counts=True)
            several = size[of] > 1
            apart &= several[x][:, None] & several[y]
        c = np.minimum(rem[x][:, None], rem[y])
        i, j = np.nonzero(apart & (c >= (least - 1e-6) * (n[x][:, None] + n[y] - c)))
        i, j = x[i], y[j]
        # n + n' - 2 * common shingles differ, and so many bits at most
        c = np.minimum(np.minimum(rem[i], rem[j]), (n[i] + n[j] - np.bitwise_count(maps[i] ^ maps[j]).sum(1, dtype=np.int64)) // 2)
        bound = c / (n[i] + n[j] - c)
        on = bound >= least - 1e-6
        i, j, bound = i[on], j[on], bound[on]
        if heavy.any():  # mass M and N left: probability Jaccard is at most 1 / (1/M + 1/N - 1)
            weighed = 1 / (1 / mass[x][:, None] + 1 / mass[y] - 1)
            k, m = np.nonzero(apart & (heavy[x][:, None] | heavy[y]) & (weighed >= least - 1e-6))
            i, j, bound = np.r_[i, x[k]], np.r_[j, y[m]], np.r_[bound, weighed[k, m]]
        flip = tid[i] > tid[j]
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        if one and len(i):
            order = np.lexsort((-bound, high, low))
            i, j, bound, low, high = (v[order] for v in (i, j, bound, low, high))
            first = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
            i, j, bound, low, high = (v[first] for v in (i, j, bound, low, high))
        return tid[i], tid[j], low, high, bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("sh", "p", "q", "tid", "label", "side", "n", "rem", "mass", "heavy")
        key, held, out, many = None, [], [], 0

        def done() -> None:
            nonlocal many
            out.append(group(*(np.concatenate(v) for v in zip(*held))))
            many += len(out[-1][0])

        def flush() -> pa.RecordBatch:
            nonlocal many
            cols = [np.concatenate(v) for v in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
            out.clear()
            many = 0
            return pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["a", "b", "low", "high", "bound"])

        for batch in batches:
            sh, p, q, *cols = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            cols.append(list_column(batch, "map")[0].reshape(-1, MAP))
            cut = np.flatnonzero((np.diff(sh) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(sh)]):
                if s == e:
                    continue
                if key != (own := (sh[s], p[s], q[s])):
                    if held:
                        done()
                    key, held = own, []
                held.append([c[s:e] for c in cols])
                if many > 100_000:
                    yield flush()
        if held:
            done()
        yield flush()

    return run


def _prefix_rows(members: DataFrame, labels: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """sh, tid, n, rem, mass, heavy, map: the prefixes of the texts in buckets that hold several classes."""
    placed = materialize(_labelled(members.select("h", "tid"), labels), "near-placed")
    per = placed.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).where("m > 2 AND low <> high").select(F.col("h").alias("oh"))
    open_ = placed.join(per, F.col("h") == F.col("oh")).select(F.col("tid").alias("t")).distinct()
    rows = materialize(bodies.join(open_, F.col("tid") == F.col("t")).select("tid", "text"), "near-open").select("tid", word_hashes(F.col("text")).alias("wh"))
    shingles = materialize(rows.mapInArrow(lean(_shingles), "sh long, tid long, times int, n int, total int"), "near-shingles")
    often = shingles.groupBy("sh").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(F.col("sh").alias("fsh"), "df")
    ordered = (
        shingles.join(often, F.col("sh") == F.col("fsh"))
        .groupBy("tid")
        .agg(F.any_value("n").alias("n"), F.any_value("total").alias("total"), F.array_sort(F.collect_list(F.struct("df", "sh", "times"))).alias("s"))
        .join(rows.mapInArrow(lean(_maps), "mtid long, map array<long>"), F.col("tid") == F.col("mtid"))
        .select("tid", "n", "total", F.col("s.sh").alias("sh"), F.col("s.times").alias("times"), "map")
    )
    return materialize(ordered.mapInArrow(lean(_prefixes(least)), "sh long, tid long, n int, rem int, mass double, heavy boolean, map array<long>"), "near-prefixes")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(tid, ...) with label: that of labels(v, label), or else the text's own number."""
    return rows.join(labels, F.col("tid") == F.col("v"), "left").select(*rows.columns, F.coalesce("label", "tid").alias("label"))


def _candidates(prefixes: DataFrame, labels: DataFrame, least: float, one: bool) -> DataFrame:
    """Pairs (a, b, block) of texts of different classes that may be similar; with one, a pair at most for any two classes.

    In a group of n blocks every row (of some 100 bytes) goes to n pairs of blocks.
    """
    rows = _labelled(prefixes, labels)
    per = rows.groupBy("sh").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).where("m > 1 AND low <> high").select(F.col("sh").alias("gsh"), F.ceil(F.col("m") / GROUP_BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(per, F.col("sh") == F.col("gsh")).withColumn("side", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    each = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("side", "o")).withColumn("q", F.greatest("side", "o"))
    sides = each.select("sh", "p", "q", "tid", "label", "side", "n", "rem", "mass", "heavy", "map").repartition("sh", "p", "q").sortWithinPartitions("sh", "p", "q")
    met = sides.mapInArrow(lean(_met(least, one)), "a long, b long, low long, high long, bound double")
    if one:
        pairs = met.groupBy("low", "high").agg(F.max(F.struct("bound", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    else:
        pairs = met.select("a", "b").distinct()
    return materialize(pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(8))), "near-candidates")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """v, label for each end of links(a, b): the smallest end of its connected component.

    Labels fall to the least among neighbours and then to the label's own label,
    which halves chains; every step works on tables in the shared folder.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("a", "b"), label)
    labels = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("v"), "label")
    while True:
        labels = materialize(labels, label)
        up = labels.select(F.col("v").alias("u"), F.col("label").alias("up"))
        near = edges.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("v") == F.col("a")).select("v", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        after = materialize(low.join(up, F.col("low") == F.col("u")).select("v", F.least("low", "up").alias("label"), "old"), label)
        if after.where("label <> old").isEmpty():
            return after.select("v", "label")
        labels = after.select("v", "label")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(v, label) after further links(a, b): components of the labels they join, which are few."""
    own = labels.select(F.col("v").alias("u"), F.col("label").alias("l"))
    ends = links.join(own, F.col("a") == F.col("u"), "left").select(F.coalesce("l", "a").alias("a"), "b").join(own, F.col("b") == F.col("u"), "left").select("a", F.coalesce("l", "b").alias("b"))
    over = components(ends).select(F.col("v").alias("o"), F.col("label").alias("new"))
    new_ends = over.select(F.col("o").alias("v"), F.col("o").alias("label")).join(labels, "v", "left_anti")
    every = labels.unionByName(new_ends)
    return materialize(every.join(over, F.col("label") == F.col("o"), "left").select("v", F.coalesce("new", "label").alias("label")), "near-labels")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, per_band: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(texts, keyed). texts: k1, k2, rep (its smallest id), class_id, class_size and head
    (whether it is its class's first) per distinct text; keyed: doc_id, k1, k2 per row of docs."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text).alias("k2"), text.alias("text"))
    signed = keyed.select("doc_id", "k1", "k2", word_hashes(F.col("text")).alias("wh")).mapInArrow(lean(_banded(bands, per_band)), keyed.select("doc_id", "k1", "k2").schema.add("bands", T.ArrayType(T.LongType())))
    texts = materialize(
        signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")).withColumn("tid", F.monotonically_increasing_id()),
        "near-texts",
    )
    exploded = texts.select("tid", F.explode(F.array_distinct("bands")).alias("h"))
    shared = exploded.groupBy("h").agg(F.min("tid").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("h").alias("sh"), "leader", "m")
    members = materialize(exploded.join(shared, F.col("h") == F.col("sh")).select("h", "tid", "leader", "m"), "near-buckets")
    # a power of two of blocks, and a number for each of them
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("m") / BLOCK)))).cast("long")
    pairs = materialize(
        members.where("tid <> leader").groupBy(F.col("leader").alias("a"), F.col("tid").alias("b")).agg(F.max("m").alias("m")).select("a", "b", (blocks + F.pmod(F.xxhash64("b"), blocks)).alias("block")), "near-pairs"
    )

    wanted = members.select("tid").distinct().join(texts.select(F.col("tid").alias("t"), F.col("k1").alias("w1"), F.col("k2").alias("w2")), F.col("tid") == F.col("t")).select("tid", "w1", "w2")
    match = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))
    if small(wanted, BROADCAST_ROWS):
        found = keyed.join(F.broadcast(wanted), match).groupBy("k1", "k2", "tid").agg(F.any_value("text").alias("text"))
    else:
        found = keyed.groupBy("k1", "k2").agg(F.any_value("text").alias("text")).join(wanted, match)
    bodies = materialize(found.select("tid", "text"), "near-bodies")

    labels = components(materialize(_verified(pairs, bodies, least), "near-links"))
    prefixes = _prefix_rows(members, labels, bodies, least)
    for one in (True, False):  # what links whole classes first, so that their other pairs need no look
        more = materialize(_verified(_candidates(prefixes, labels, least, one), bodies, least), "near-links")
        if not more.isEmpty():
            labels = _merged(labels, more)

    classed = texts.join(labels, F.col("tid") == F.col("v"), "left").select("k1", "k2", "rep", "copies", F.coalesce("label", "tid").alias("label"))
    first = F.struct(F.col("rep").isNull().alias("n"), "rep", "k1", "k2")
    per = classed.groupBy("label").agg(F.min(first).alias("f"), F.sum("copies").alias("class_size")).withColumnRenamed("label", "l")
    head = (F.col("k1") == F.col("f.k1")) & (F.col("k2") == F.col("f.k2"))
    out = classed.join(per, F.col("label") == F.col("l")).select("k1", "k2", "rep", F.col("f.rep").alias("class_id"), "class_size", head.alias("head"))
    return out, keyed.select("doc_id", "k1", "k2")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    Documents are linked when their texts are equal, or when the probability
    Jaccard similarity of their shingles (weighted by occurrence), or the plain
    one, is ``least`` or more. Classes are the connected components; class_id is
    the smallest doc_id in the class, and that document is kept.

    Texts are told apart by two 64-bit hashes of the whole text.

    Edge cases: null text counts as empty; empty texts form one class; very long
    texts are hashed in whole, one task holds one or two of them at a time; a null id
    is never the smallest unless the class has no other; rows that repeat an id
    and its text are all marked kept if the first is (see ``drop_near_duplicates``
    for exactly one); an empty table gives an empty result; further columns are
    ignored.
    """
    texts, keyed = near_duplicate_classes(docs, id_col, text_col, least)
    t = texts.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), "class_id", "class_size")
    return keyed.join(t, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: all its columns, of the row with the smallest id.

    Edge cases are those of ``near_dedup``; of rows that repeat that id and its
    text one stays; columns of docs may have any name but those that begin with
    __lw_.
    """
    texts, keyed = near_duplicate_classes(docs, id_col, text_col, least)
    heads = texts.where("head").select("rep", "k1", "k2")
    times = keyed.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("times"))
    head = (
        heads.join(times.select(F.col("doc_id").alias("d"), F.col("k1").alias("d1"), F.col("k2").alias("d2"), "times"), F.col("rep").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")))
        .select(F.col("rep").alias("__lw_id"), F.col("k1").alias("__lw_1"), F.col("k2").alias("__lw_2"), F.col("times").alias("__lw_times"))
    )
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.join(head, docs[id_col].eqNullSafe(head["__lw_id"]) & (F.xxhash64(text) == head["__lw_1"]) & (F.xxhash64(F.lit("k2"), text) == head["__lw_2"]))
    once = rows.where("__lw_times = 1")
    repeated = rows.where("__lw_times > 1").dropDuplicates(["__lw_id", "__lw_1", "__lw_2"])
    return once.unionByName(repeated).select(*docs.columns)
