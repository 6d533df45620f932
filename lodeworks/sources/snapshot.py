"""A snapshot store: tables as Parquet folders, each write a new snapshot.

A table's pointer is the highest numbered snapshot with a _SUCCESS file, so a
write that dies half-way is never read, and readers keep the snapshot they have
opened. ``vacuum`` drops older ones. Snapshots live in any store Spark can write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import KEYS, SCHEMAS, empty


def last_wins(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: the one with the highest ``order``; without it any one of equal rows.

    max_by over a struct folds on the map side, so a key that repeats through a
    third of the batch stays small.
    """
    if order is None:
        return rows.dropDuplicates([key])
    best = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return best.select("r.*")


def upsert(current: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """current with the batch's rows put in place of those of equal key."""
    new = last_wins(batch, key, order)
    return current.join(new.select(key), key, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def delete_where_in(current: DataFrame, column: str, values: DataFrame | list) -> DataFrame:
    """current without rows whose column is among the values (a list, or a DataFrame's first column); none for an empty list."""
    if isinstance(values, list):
        return current.where(~F.coalesce(F.col(column).isin(values), F.lit(False))) if values else current
    v = values.select(F.col(values.columns[0]).alias("__v"))
    return current.join(v, F.col(column) == F.col("__v"), "left_anti")


def check_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """chunks, failing on the first embedding of another length."""
    ok = F.col("embedding").isNull() | (F.size("embedding") == dim)
    return chunks.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"embedding must have {dim} dimensions, has "), F.size("embedding")))))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete snapshots in a folder, ascending."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        return versions(self.spark, f"{self.path}/{table}")

    def read(self, table: str) -> DataFrame:
        """The newest snapshot; an empty table if there is none."""
        versions = self._versions(table)
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}/{versions[-1]:09d}") if versions else empty(self.spark, table)

    def write(self, table: str, rows: DataFrame) -> None:
        n = (self._versions(table) or [-1])[-1] + 1
        if table == "chunks" and self.dim:
            rows = check_dimension(rows, self.dim)
        # sorted inside files, so row groups outside a looked-up file or source are skipped
        order = {"symbols": ("file_path", "id"), "relationships": ("source_symbol_id", "id"), "chunks": ("file_path", "id")}[table]
        rows.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/{table}/{n:09d}")

    def upsert(self, table: str, batch: DataFrame, order: str | None = None) -> None:
        self.write(table, upsert(self.read(table), batch, KEYS[table], order))

    def delete_files(self, paths: list[str]) -> None:
        """Symbols and chunks of the files, and the edges of those symbols."""
        symbols = self.read("symbols")
        gone = symbols.where(F.col("file_path").isin(paths)).select("id")
        edges = self.read("relationships")
        self.write("relationships", delete_where_in(delete_where_in(edges, "source_symbol_id", gone), "target_symbol_id", gone))
        self.write("chunks", delete_where_in(self.read("chunks"), "file_path", paths))
        self.write("symbols", delete_where_in(symbols, "file_path", paths))

    def clear(self) -> None:
        for table in SCHEMAS:
            p, fs = self._fs(f"{self.path}/{table}")
            fs.delete(p, True)

    def vacuum(self, keep: int = 1) -> None:
        for table in SCHEMAS:
            for n in self._versions(table)[: -keep or None]:
                p, fs = self._fs(f"{self.path}/{table}/{n:09d}")
                fs.delete(p, True)
