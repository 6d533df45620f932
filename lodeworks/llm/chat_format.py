"""Chat formatting with cumulative-snapshot collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers to a segment: bounds what one task gathers of a conversation.
SEGMENT = 256


def chat_format(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Maximal conversations, rendered: conv_id, segment, n_turns, n_copies, text.

    ``turns`` has conv_id, turn, role, text. Loggers often store a conversation
    after every exchange, so one conversation shows up as many snapshots, each a
    prefix of the next. Every turn gets a 128-bit hash of its number, role and
    text; the running xor along a conversation is its rolling prefix hash. A
    conversation whose whole hash is a proper prefix of another one is dropped
    by an anti-join; of equal conversations the smallest conv_id stays, and
    ``n_copies`` tells how many were equal. What stays is rendered as
    ``<|role|>`` line, text line, ``<|end|>`` line per turn.

    Nothing gathers a whole conversation: running hashes are made inside blocks
    of ``segment`` turn numbers and combined with the blocks' totals, and text is
    rendered one row per ``segment`` turn numbers (ordinary conversations have
    just segment 0). The anti-join compares distinct hashes, so one first turn or
    one conversation that makes up a third of the table is one row on each side.

    Edge cases: repeated rows count once; differing rows with one turn number
    all stay, by role then text (nulls first); null role or text renders as
    empty, and is different from the empty one when hashed; a row without
    conv_id or turn can't be placed and is a conversation of its own, never
    collapsed; an empty table gives an empty result; other columns are ignored.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    placed = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("segment", F.floor(F.col("turn") / segment))
    loose = rows.where("conv_id IS NULL OR turn IS NULL")

    parts = ["turn", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = placed.select("conv_id", "segment", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("tie"), F.col("text").isNull().alias("no_text"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b"))

    inside = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", F.desc("no_text"), "tie").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    starts = blocks.select(
        "conv_id",
        "segment",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("a0"),
        F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("b0"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    running = (
        hashed.select("conv_id", "segment", F.count(F.lit(1)).over(inside).alias("n1"), F.bit_xor("a").over(inside).alias("a1"), F.bit_xor("b").over(inside).alias("b1"))
        .join(starts, ["conv_id", "segment"])
        .select("conv_id", (F.col("n0") + F.col("n1")).alias("pn"), F.col("a0").bitwiseXOR(F.col("a1")).alias("pa"), F.col("b0").bitwiseXOR(F.col("b1")).alias("pb"))
    )
    sizes = whole.select("conv_id", F.col("n").alias("total"))
    prefixes = running.join(sizes, "conv_id").where("pn < total").select("pn", "pa", "pb").distinct()
    maximal = (
        whole.groupBy("n", "a", "b")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
        .join(prefixes, (F.col("n") == F.col("pn")) & (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")), "left_anti")
        .select("conv_id", F.col("n").alias("n_turns"), "n_copies")
    )
    line = lambda role, text: F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))
    kept = (
        placed.join(maximal, "conv_id")
        .groupBy("conv_id", "segment", "n_turns", "n_copies")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").isNotNull().alias("has"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"), "text"))).alias("t"))
        .select("conv_id", "segment", "n_turns", "n_copies", F.array_join(F.transform("t", lambda x: line(x["role"], x["text"])), "").alias("text"))
    )
    alone = loose.select("conv_id", F.lit(0).cast("long").alias("segment"), F.lit(1).cast("long").alias("n_turns"), F.lit(1).cast("long").alias("n_copies"), line(F.col("role"), F.col("text")).alias("text"))
    return kept.unionByName(alone)
