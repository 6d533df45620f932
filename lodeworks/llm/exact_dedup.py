"""Exact dedup by 128-bit content hash with byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts group by ``digest`` of the normalised text; inside a group the
    aggregation compares the whole text byte by byte, so texts that merely
    collide stay apart, whatever the digest. The smallest id of a class stays;
    where whole rows repeat (same id, same text) exactly one of them is kept.

    A class that holds a third of all rows is folded to one row per map task
    before the shuffle. The join back carries hashes only; its large side may be
    skewed and its small side has one row per class, so adaptive execution can
    split it.

    Edge cases: null or empty text form one class of the empty text; a null id
    sorts after every other, and is the kept id only of a class with no other;
    an empty table gives an empty result; further columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    keyed = base.select("doc_id", digest(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"), "norm")
    classes = (
        keyed.groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.col("h").alias("ch"), F.sha2("norm", 256).alias("csha"), "keep_id", "group_size")
    )
    rows = keyed.groupBy("doc_id", "h", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    found = rows.join(classes, (F.col("h") == F.col("ch")) & (F.col("text_sha256") == F.col("csha")), "left")
    grouped = F.col("group_size").isNotNull()
    return (
        found.select(
            "doc_id",
            F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            "text_sha256",
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )
