"""Tables of a data folder, as DataFrames and as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the path may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, names: list[str]) -> DataFrame:
    """Run SQL in which {name} stands for a table of the folder."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})
