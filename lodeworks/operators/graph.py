"""Dependency graph operators over symbols and relationships.

Hops are joins. A trace of depth d is at most d joins of a frontier with the
edges, whatever the number of nodes, and the frontier is a DataFrame throughout.
A frontier goes to the edges, not the edges to it: see ``touching``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

MAX_DEPTH = 3
#: Up to so many ids are broadcast as they are; for more, a hash filter of at most so many words of 64 bits (32 MB).
FEW, MOST_WORDS = 100_000, 2**22


def edges_out(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source_symbol_id") == node)


def edges_in(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("target_symbol_id") == node)


def edges_all(edges: DataFrame, node: str) -> DataFrame:
    """Out-edges and in-edges; a self-loop appears twice."""
    return edges_out(edges, node).unionByName(edges_in(edges, node))


def resolve(symbols: DataFrame, path: str) -> DataFrame:
    """The symbol of that full name, else one of that name; at most one row, ties by id."""
    rank = F.when(F.col("full_name") == path, 0).otherwise(1)
    return symbols.where((F.col("full_name") == path) | (F.col("name") == path)).orderBy(rank, "id").limit(1)


def descendants(symbols: DataFrame, full_name: str) -> DataFrame:
    """Symbols below a full name, at any depth."""
    return symbols.where(F.col("full_name").startswith(full_name + "."))


def with_descendants(symbols: DataFrame, path: str) -> DataFrame:
    """id of the resolved symbol and of everything below it."""
    root = resolve(symbols, path).select(F.col("id").alias("rid"), F.col("full_name").alias("rname"))
    below = symbols.join(F.broadcast(root), F.col("full_name").startswith(F.concat("rname", F.lit(".")))).select("id")  # root is one row
    return root.select(F.col("rid").alias("id")).union(below).distinct()


def with_payload(rows: DataFrame, symbols: DataFrame, id_col: str = "node") -> DataFrame:
    """Adds symbol_name, file_path and kind; an unknown id stands for its own name, the edge type for its kind."""
    s = symbols.select(F.col("id").alias("sid"), F.col("name").alias("sname"), F.col("kind").alias("skind"), F.col("file_path").alias("sfile"))
    return (
        rows.join(s, F.col(id_col) == F.col("sid"), "left")
        .withColumn("symbol_name", F.coalesce("sname", F.col(id_col)))
        .withColumn("kind", F.coalesce("skind", "relationship_type"))
        .withColumn("file_path", F.coalesce("sfile", F.lit("")))
        .drop("sid", "sname", "skind", "sfile")
    )


def _slot(id_: Column, words: int) -> tuple[Column, Column, Column]:
    """Where the hash filter keeps an id: its row, the word in that row, and the two bits of that word."""
    h = F.xxhash64(id_)
    word = F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(words - 1))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftright(word, 6), word.bitwiseAND(F.lit(63)).cast("int"), bit(h).bitwiseOR(bit(F.shiftright(h, 6)))


def hash_filter(ids: DataFrame, words: int) -> DataFrame:
    """slot, words: the bits of ids(at) in rows of 64 words, a power of two in all."""
    slot, word, bits = _slot(F.col("at"), words)
    of_word = ids.select(slot.alias("slot"), word.alias("word"), bits.alias("bits")).repartition("slot").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits"))
    of_slot = of_word.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    return of_slot.select("slot", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0).cast("long"))).alias("words"))


def touching(edges: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Edges whose column is among ids(id), which have been cut.

    What is sent to every task is the ids, or a filter of their hashes that
    never outgrows 32 MB and lets few other edges pass; those few and the
    matches are then joined exactly. As a semi-join with a broadcast side it
    is pushed below the DISTINCT and unions that make up edges, so only edges
    that match are shuffled, not all of them at each level.
    """
    ids = ids.select(F.col("id").cast(edges.schema[column].dataType).alias("at"))
    n = ids.count()
    if n <= FEW:
        return edges.join(F.broadcast(ids), F.col(column) == F.col("at"), "left_semi")
    words = min(max(1 << (n // 2).bit_length(), 64), MOST_WORDS)
    slot, word, bits = _slot(F.col(column), words)
    likely = edges.join(F.broadcast(hash_filter(ids, words)), (slot == F.col("slot")) & (F.col("words")[word].bitwiseAND(bits) == bits), "left_semi")
    return likely.join(ids.hint("merge"), F.col(column) == F.col("at"), "left_semi")


def trace(edges: DataFrame, starts: DataFrame, direction: str = "upstream", depth: int = 1) -> DataFrame:
    """Breadth-first trace from starts(id): level, edge_id, direction, node, relationship_type.

    upstream follows edges from source to target (what a symbol uses), downstream
    the other way (what uses it), both does either. Depth is clamped to 1..3. One
    row per (edge, direction), at the level it is first met; nodes met before
    aren't expanded again, so cycles end. A level and the frontier after it are
    written before the next one starts, so each level reads the edges once.
    """
    depth = min(max(depth, 1), MAX_DEPTH)
    first = cut(starts.select("id").distinct())
    return reduce(DataFrame.unionByName, [_trace(edges, first, d, depth) for d in (("upstream", "downstream") if direction == "both" else (direction,))])


def _trace(edges: DataFrame, first: DataFrame, direction: str, depth: int) -> DataFrame:
    here, there = ("source_symbol_id", "target_symbol_id") if direction == "upstream" else ("target_symbol_id", "source_symbol_id")
    frontier = seen = first
    levels = []
    for level in range(1, depth + 1):
        step = touching(edges, here, frontier).select(F.col("id").alias("edge_id"), F.col(there).alias("node"), "relationship_type")
        if level < depth:
            step = cut(step)
            frontier = cut(step.select(F.col("node").alias("id")).distinct().join(seen, "id", "left_anti"))
            seen = seen.union(frontier)
        levels.append(step.select(F.lit(level).alias("level"), "edge_id", F.lit(direction).alias("direction"), "node", "relationship_type"))
    return reduce(DataFrame.unionByName, levels)


def related(edges: DataFrame, symbols: DataFrame, path: str, kind: str = "all") -> DataFrame:
    """Edges that touch a symbol or its descendants, once each, with the target's payload and the other end."""
    own = with_descendants(symbols, path).select(F.col("id").alias("own"))
    touched = edges.join(own, F.col("source_symbol_id") == F.col("own")).unionByName(edges.join(own, F.col("target_symbol_id") == F.col("own")))
    if kind.lower() != "all":
        touched = touched.where(F.lower("relationship_type") == kind.lower())
    once = touched.groupBy("id", "source_symbol_id", "target_symbol_id", "relationship_type").agg(F.min("own").alias("own"))
    other = F.when(F.col("source_symbol_id") == F.col("own"), F.col("target_symbol_id")).otherwise(F.col("source_symbol_id"))
    return with_payload(once.withColumn("other_symbol", other), symbols, "target_symbol_id").select("id", "symbol_name", "file_path", "kind", "relationship_type", "other_symbol")


def test_coverage(edges: DataFrame, symbols: DataFrame, starts: DataFrame, marker: str = "TestCoverage", stem: str = "(?i)tests?$") -> DataFrame:
    """Covering symbols of starts(id): node, file_path.

    Stored edges of type ``marker`` win; where a start has none, neighbours whose
    file's stem ends in Test or Tests count.
    """
    start = starts.select(F.col("id").alias("start"))
    stored = edges.where(F.col("relationship_type") == marker).join(start, F.col("target_symbol_id") == F.col("start")).select("start", F.col("source_symbol_id").alias("node"))
    lone = start.join(stored.select("start").distinct(), "start", "left_anti")
    near = edges.join(lone, F.col("target_symbol_id") == F.col("start")).select("start", F.col("source_symbol_id").alias("node")).union(edges.join(lone, F.col("source_symbol_id") == F.col("start")).select("start", F.col("target_symbol_id")))
    files = symbols.select(F.col("id").alias("sid"), "file_path")
    file_stem = F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.[^.]*$", "")
    by_name = near.join(files, F.col("node") == F.col("sid")).where(file_stem.rlike(stem)).select("start", "node", "file_path")
    by_edge = stored.join(files, F.col("node") == F.col("sid"), "left").select("start", "node", F.coalesce("file_path", F.lit("")).alias("file_path"))
    return by_edge.unionByName(by_name).distinct()


def impact_files(traced: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct non-empty files of the nodes of a trace."""
    return with_payload(traced, symbols).where("file_path <> ''").select("file_path").distinct()


def impact_components(files: DataFrame) -> DataFrame:
    """Top-level components of files, with the number of files each."""
    return files.groupBy(F.split("file_path", "/")[0].alias("component")).agg(F.count(F.lit(1)).alias("files"))
