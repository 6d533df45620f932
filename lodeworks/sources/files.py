"""Source files as DataFrames: the crawl, with ignore rules and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TEXT_LIMIT, IgnoreRules, detect_language, extension, truncate_utf8

#: Folders never entered.
SKIPPED = (".git", ".lodeworks")


def relative_path(uri, root: str):
    """The part of a file URI below root."""
    bare = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(F.substring_index(uri, bare + "/", -1), "^/+", "")


def utf8(raw):
    """Bytes as text, without those that aren't UTF-8."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def crawl(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore: str = "", compat: bool = False) -> DataFrame:
    """file_path (below root), content, language, size of the files under root.

    Spark lists the folder in parallel and reads each file in a task; files that
    vanish meanwhile are skipped. Contents that aren't UTF-8 lose the bad bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    named = files.select(relative_path(F.col("path"), root).alias("file_path"), F.col("content").alias("raw"), F.col("length").alias("size"))
    return select_files(named, extensions, ignore, compat).select("file_path", utf8(F.col("raw")).alias("content"), "size").withColumn("language", detect_language(F.col("file_path"), F.col("content")))


def select_files(files: DataFrame, extensions: list[str] | None = None, ignore: str = "", compat: bool = False) -> DataFrame:
    """Rows whose file_path isn't in a skipped folder, has an allowed extension and isn't ignored."""
    path = F.col("file_path")
    for folder in SKIPPED:
        files = files.where(~path.startswith(folder + "/"))
    if extensions:
        files = files.where(extension(path).isin(*[e.lstrip(".").lower() for e in extensions]))
    return files.where(~IgnoreRules(ignore, compat).matches(path)) if ignore else files


def text_files(files: DataFrame, most: int = TEXT_LIMIT) -> DataFrame:
    """Files that aren't blank, cut at ``most`` bytes on a character border."""
    return files.where(F.length(F.trim("content")) > 0).withColumn("content", truncate_utf8(F.col("content"), most))
