"""Benchmark decontamination: n-gram windows against a broadcast hash set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .url_filter import LOWER, UPPER

#: Words to a window; an item of fewer words is one window.
WINDOW = 10
#: Separators: everything ASCII that is no letter or digit.
_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NOT_SEP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A broadcast holds at most so many windows, and bytes of their words; which items have them stays behind.
BLOCK, BLOCK_BYTES = 200_000, 64 << 20


def raw_words(text: Column) -> Column:
    """The words as they stand; A-Z are folded later, where it matters."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEP), "")


def _fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _hashes(df: DataFrame, words: str, lens: list[int]) -> DataFrame:
    """Adds an array column __h<n> for each n of lens: at i the hash of the n words from i on.

    Entries whose window would run past the end are meaningless. Hashes of 1, 2,
    4 and 8 words are built by doubling, so a window costs a few hash steps
    however long it is. The lower() here folds more than A-Z; hits are verified
    on the exact words.
    """
    df = df.withColumn("__p1", F.transform(words, lambda w: F.xxhash64(F.lower(w))))
    power = 1
    pair = lambda x, y, k: F.zip_with(x, F.slice(y, k + 1, 1 << 30), lambda a, b: F.xxhash64(a, b))
    while power * 2 <= max(lens):
        df = df.withColumn(f"__p{2 * power}", pair(F.col(f"__p{power}"), F.col(f"__p{power}"), power))
        power *= 2
    for n in lens:
        bits = [b for b in (1 << i for i in reversed(range(n.bit_length()))) if n & b]
        at, acc = bits[0], F.col(f"__p{bits[0]}")
        for b in bits[1:]:
            acc, at = pair(acc, F.col(f"__p{b}"), at), at + b
        df = df.withColumn(f"__h{n}", acc)
    return df


def _exploded(df: DataFrame, keep: list[Column | str], words: str, lens: list[int]) -> DataFrame:
    """keep and (pos, len, hash), a row for each full window of df's rows."""
    df = _hashes(df, words, lens)
    at = F.col("__at")
    n = F.size(words)
    slot = F.floor(at / n).cast("int")
    return (
        df.select(*keep, words, F.posexplode_outer(F.concat(*[F.col(f"__h{k}") for k in lens])).alias("__at", "hash"))
        .withColumn("pos", (at % n).cast("int"))
        .withColumn("len", F.element_at(F.array(*[F.lit(k) for k in lens]), slot + 1) if len(lens) > 1 else F.lit(lens[0]))
        .where(F.col("pos") + F.col("len") <= n)
    )


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: hash, blen, bwords (joined by a space), items (ids as text), wid (a number)."""
    items = (
        benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("t"))
        .groupBy("t")
        .agg(F.collect_set("item").alias("item"))
        .select("item", raw_words(F.col("t")).alias("w"))
    )
    n = F.size("w")
    parts = []
    for k in range(1, window + 1):
        own = items.where(n >= window if k == window else n == k)
        parts.append(_exploded(own, ["item"], "w", [k]).select("hash", F.col("len").alias("blen"), _fold(F.array_join(F.slice("w", F.col("pos") + 1, k), " ")).alias("bwords"), F.explode_outer("item").alias("item")))
    every = reduce(DataFrame.unionByName, parts)
    return materialize(every.groupBy("hash", "blen", "bwords").agg(F.collect_set("item").alias("items")).withColumn("wid", F.monotonically_increasing_id()), "benchmark-windows")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, base, known). hits: doc_id, key, pos, len, wid, a row for each verified
    occurrence of a benchmark window in a document; base: doc_id, key, n_words;
    known: ``benchmark_windows``. key is the md5 of the text and tells apart
    documents that share an id.

    Document windows meet a broadcast hash table of the benchmark's windows and
    are verified word by word. A benchmark of more than ``block`` windows, or
    BLOCK_BYTES of them, is taken in blocks of that size, one scan each, so the
    broadcast is bounded.
    """
    known = benchmark_windows(benchmark, window=window)
    seen = known.groupBy("blen").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("bwords") + 64).alias("bytes")).collect()  # at most `window` rows
    lens = sorted((r["blen"] for r in seen), reverse=True) or [window]
    blocks = max(1, -(-sum(r["n"] for r in seen) // block), -(-sum(r["bytes"] for r in seen) // BLOCK_BYTES))
    text = F.col(text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("key"), raw_words(text).alias("w"))
    windows = _exploded(src, ["doc_id", "key"], "w", lens)
    # inside coalesce() the comparison is no join key: it is made for windows of equal hash only
    exact = F.coalesce(_fold(F.array_join(F.slice("w", F.col("pos") + 1, F.col("len")), " ")) == F.col("bwords"), F.lit(False))
    found = []
    for b in range(blocks):
        part = F.broadcast(known.where(F.pmod("hash", F.lit(blocks)) == b).select(F.col("hash").alias("bh"), "blen", "bwords", "wid"))
        found.append(windows.join(part, (F.col("hash") == F.col("bh")) & (F.col("len") == F.col("blen")) & exact).select("doc_id", "key", "pos", "len", "wid"))
    return reduce(DataFrame.unionByName, found), src.select("doc_id", "key", F.size("w").cast("long").alias("n_words")), known


def _per_doc(hits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row for each hit (doc_id, key): hid, hkey, the covered word positions and, with known, the items."""
    spans = F.collect_set(F.struct("pos", "len"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))
    per = hits.groupBy("doc_id", "key").agg(spans.alias("spans"), F.collect_set("wid").alias("wids")).select(F.col("doc_id").alias("hid"), F.col("key").alias("hkey"), covered.alias("covered"), "wids")
    if known is None:
        return per.drop("wids")
    names = known.select(F.col("wid").alias("w"), "items")
    named = per.select("hid", "hkey", F.explode("wids").alias("wid")).join(names, F.col("wid") == F.col("w")).groupBy(F.col("hid").alias("nid"), F.col("hkey").alias("nkey")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return per.join(named, F.col("hid").eqNullSafe(F.col("nid")) & (F.col("hkey") == F.col("nkey")), "left").select("hid", "hkey", "covered", "items")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any verified occurrence of a benchmark window is hit.

    Edge cases: null and empty texts have no words; very long texts are hashed
    whole, in one row; repeated rows each get the
    same result; null ids work like others; an item without words has no window,
    an item with a null id hits words but isn't listed; empty tables give no
    rows (documents) or no hits (benchmark); further columns are ignored.
    """
    hits, base, known = contamination(docs, benchmark, id_col, text_col, window, block)
    per = _per_doc(materialize(hits, "benchmark-hits"), known)
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("covered"), F.lit(0)).cast("long")
    n_hit = F.when(F.col("covered").isNull(), F.lit(0).cast("long")).otherwise(n_hit)
    return base.join(per, F.col("doc_id").eqNullSafe(F.col("hid")) & (F.col("key") == F.col("hkey")), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without contamination; every column of docs comes back.

    ``mode='documents'`` drops documents with any hit. ``mode='spans'`` keeps all
    documents and cuts each hit word with the separators before it out of the
    text; the rest of the text is unchanged.

    Edge cases are those of ``decontamination_report``; null texts stay null;
    repeated rows go or stay together; columns of docs may have any name but hid,
    hkey and covered.
    """
    hits, _, _ = contamination(docs, benchmark, id_col, text_col, window)
    per = _per_doc(hits)
    key = F.md5(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].eqNullSafe(per["hid"]) & (key == per["hkey"])
    if mode == "documents":
        return docs.join(per, same, "left_anti")
    if mode != "spans":
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    text = docs[text_col]
    seps, words = F.split(text, _NOT_SEP), raw_words(text)
    left = F.filter(
        F.transform(F.arrays_zip(F.slice(seps, 1, F.size(words)).alias("s"), words.alias("w")), lambda x, i: F.when(~F.array_contains(per["covered"], i), F.concat(x["s"], x["w"]))),
        lambda x: x.isNotNull(),
    )
    cut = F.concat(F.array_join(left, ""), F.element_at(seps, -1))
    new = F.when(per["covered"].isNull(), text).otherwise(cut)
    return docs.join(per, same, "left").select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])
