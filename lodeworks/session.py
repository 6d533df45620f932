"""Helpers on the Spark session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_lodeworks_shipped", False):
        return
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp()) / "lodeworks_package.zip"  # read by the driver, which serves it to the executors
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._lodeworks_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; where it is unset, on a single machine, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(sc, "_lodeworks_shared", None):
        sc._lodeworks_shared = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
    return sc._lodeworks_shared


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its rows in the shared folder: later readers don't go back to where it came from."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def create(master: str = "local[*]", name: str = "lodeworks", **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, adaptive execution, Arrow."""
    b = SparkSession.builder.master(master).appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
