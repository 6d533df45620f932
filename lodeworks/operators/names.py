"""Name resolution and containment: raw target names to symbols, lines to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_names(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs(ref_id, target) with the symbol each target names: ref_id, target, symbol_id, rule.

    Rules, best first: the exact full name, the name, the name before a ``(``.
    Every symbol offers its three keys, so resolution is one equi-join and a
    minimum; ties go to the smallest id. Unresolved references are left out.
    """
    keys = F.array(F.struct(F.lit(1).alias("rule"), F.col("full_name").alias("k")), F.struct(F.lit(2).alias("rule"), F.col("name").alias("k")), F.struct(F.lit(3).alias("rule"), F.substring_index("name", "(", 1).alias("k")))
    offered = symbols.select("id", F.explode(keys).alias("o")).select("id", "o.rule", "o.k").groupBy("k").agg(F.min(F.struct("rule", "id")).alias("best"))
    return refs.join(offered, F.col("target") == F.col("k")).select("ref_id", "target", F.col("best.id").alias("symbol_id"), F.col("best.rule").alias("rule"))


def containing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points(file_path, line) with the symbol of the smallest line range around them: file_path, line, symbol_id."""
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("file_path").alias("sfile"), "line_start", "line_end")
    near = points.join(s, (F.col("file_path") == F.col("sfile")) & (F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end")))
    return near.groupBy("file_path", "line").agg(F.min_by("symbol_id", F.struct(F.col("line_end") - F.col("line_start"), "symbol_id")).alias("symbol_id"))
