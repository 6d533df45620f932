"""Change history: hotspots and histories from commits(hash, author, date, subject, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hotspots(commits: DataFrame, top: int = 10) -> DataFrame:
    """path, commits, authors, first_date, last_date of the most changed paths."""
    per = commits.groupBy("path").agg(F.countDistinct("hash").alias("commits"), F.countDistinct("author").alias("authors"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return per.orderBy(F.desc("commits"), "path").limit(top)


def newest(df: DataFrame, key: str, value: str, order: list[str], n: int = 10) -> DataFrame:
    """key, newest: the values of the n last rows of each key, newest first.

    A ranked window keeps n rows of a key before anything is gathered, and Spark
    prunes the ranks before the shuffle (WindowGroupLimit).
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    top = df.withColumn("__rank", rank).where(F.col("__rank") <= n)
    return top.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__rank", value))), lambda x: x[value]).alias("newest"))


def history(commits: DataFrame, n: int = 10) -> DataFrame:
    """path, commits, authors, first_date, last_date, newest (the n newest hashes)."""
    per = commits.groupBy("path").agg(F.countDistinct("hash").alias("commits"), F.countDistinct("author").alias("authors"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return per.join(newest(commits.select("path", "hash", "date").distinct(), "path", "hash", ["date", "hash"], n), "path")
