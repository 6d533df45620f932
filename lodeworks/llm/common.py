"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: Runs of ASCII white space, and of anything else, as Java and RE2 both read them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/lodeworks/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage: later readers, and executors started after a loss, read
    the files instead of recomputing. ``release`` deletes the files.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give back to the system what this process has freed, but Arrow and the C library still hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with ``trim`` at its end: workers that wait for other tasks count towards their executor's memory."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return lean_run


def written() -> list[tuple[SparkSession, str]]:
    """The intermediate tables of this process that still exist, oldest first."""
    return list(_written)


def release(spark: SparkSession, tables: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete intermediate tables, all by default.

    Call it once the results built on them have been written.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for entry in written() if tables is None else tables:
        if entry in _written:
            _written.remove(entry)
            p = jvm.org.apache.hadoop.fs.Path(entry[1])
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["SPACE", "WORD", "crc_fold", "lean", "materialize", "new_path", "release", "shared_dir", "ship", "small", "table", "trim", "written"]


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def small(df: DataFrame, most: int) -> bool:
    """Whether df has at most that many rows; reads no more than needed to tell."""
    return df.limit(most + 1).count() <= most
