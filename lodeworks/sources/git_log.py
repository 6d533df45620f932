"""Commit logs: the git command on the driver, or an exported log file."""

from __future__ import annotations

import logging
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record separator, a line with the commit's fields parted by tabs, then one line for each path. Git quotes the separator where a path has it.
FORMAT = "--pretty=format:%x1e%H%x09%an%x09%ad%x09%s"
_SEP = "\x1e"
COMMITS = "hash string, author string, date date, subject string, path string"


def read_git(spark: SparkSession, repo: str, most: int | None = None, timeout: int = 30) -> DataFrame:
    """commits of a local clone; a failing or slow git gives an empty table and a warning."""
    args = ["git", "-C", repo, "-c", "core.quotePath=false", "log", FORMAT, "--date=short", "--name-only", "--diff-filter=AM"] + ([f"-{most}"] if most else [])
    try:
        text = subprocess.run(args, capture_output=True, text=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError) as e:
        logging.getLogger(__name__).warning("git log of %s failed: %s", repo, e)
        text = ""
    rows = []
    for record in text.split(_SEP)[1:]:
        head, *paths = record.split("\n")
        rows += [(*(head.split("\t", 3) + [""] * 4)[:4], p) for p in paths if p.strip()]
    return spark.createDataFrame(rows, "hash string, author string, date string, subject string, path string").withColumn("date", F.to_date("date"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """commits of log files in FORMAT, parsed in parallel, a record at each separator."""
    records = spark.read.option("lineSep", _SEP).text(path).where("value <> ''")
    lines = F.split("value", "\n")
    head = F.split(lines[0], "\t", 4)
    parsed = records.select(head[0].alias("hash"), head[1].alias("author"), F.to_date(head[2]).alias("date"), head[3].alias("subject"), F.explode(F.filter(F.slice(lines, 2, 1 << 30), lambda x: F.trim(x) != "")).alias("path"))
    return parsed.where(F.col("hash").rlike("^[0-9a-f]{5,}$"))


def clone(url: str, target: str, branch: str | None = None, timeout: int = 300) -> bool:
    """git clone --depth 1 on the driver; whether it worked."""
    args = ["git", "clone", "--depth", "1", *(["--branch", branch] if branch else []), "--", url, target]
    try:
        return subprocess.run(args, capture_output=True, timeout=timeout).returncode == 0
    except (OSError, subprocess.SubprocessError):
        return False
