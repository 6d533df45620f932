"""Incremental indexing: a stream of changes, applied batch by batch to a snapshot store.

Within a batch the latest change of a key wins and deletes come before inserts,
so the store ends where replaying the changes one by one would end. The state is
the store itself, so no watermark is needed, and a batch that is replayed after
a failure gives the same store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vectors
from ..operators.extraction import extract_references, extract_symbols, with_symbol_ids
from ..operators.chunking import symbol_chunks
from ..operators.names import resolve_names
from ..sources.snapshot import SnapshotStore, upsert, versions


def latest_per_key(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key; folds on the map side."""
    last = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(v, last).alias(v) for v in values])


def edges_of(references: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Relationship rows of raw references, resolved by joins; unresolved ones go."""
    refs = references.withColumn("ref_id", F.concat_ws("|", "file_path", "source", "target", "relationship_type"))
    named = resolve_names(refs.select("ref_id", "target").distinct(), targets).select(F.col("ref_id").alias("r"), F.col("symbol_id").alias("target_symbol_id"))
    own = sources.select(F.col("id").alias("source_symbol_id"), F.col("full_name").alias("fn"), F.col("file_path").alias("fp"))
    joined = refs.join(own, (F.col("source") == F.col("fn")) & (F.col("file_path") == F.col("fp"))).join(named, F.col("ref_id") == F.col("r"))
    edges = joined.where("source_symbol_id <> target_symbol_id").select("source_symbol_id", "target_symbol_id", "relationship_type").distinct()
    return edges.select(F.concat("source_symbol_id", F.lit("->"), "target_symbol_id", F.lit(":"), "relationship_type").alias("id"), "*")


def embedded(chunks: DataFrame, store: SnapshotStore) -> DataFrame:
    """Chunks, once for each id, with the embedding of their content in the store's dimension."""
    return chunks.dropDuplicates(["id"]).withColumn("embedding", vectors.embed_column(F.col("content"), store.dim or vectors.DIM))


def index_files(files: DataFrame, store: SnapshotStore) -> None:
    """Full index of files(file_path, content, language): symbols, edges and chunks with their embeddings replace what the store has."""
    files = files.persist()
    try:
        store.write("symbols", with_symbol_ids(extract_symbols(files)))
        symbols = store.read("symbols")
        store.write("relationships", edges_of(extract_references(files), symbols, symbols))
        store.write("chunks", embedded(symbol_chunks(files, symbols), store))
    finally:
        files.unpersist()


def apply_changes(changes: DataFrame, store: SnapshotStore) -> None:
    """changes(file_path, seq, deleted, content, language): the last change of each file takes effect.

    A changed file loses its symbols, chunks and edges and is extracted again;
    its references resolve against all symbols. Edges from other files into a
    changed file follow their target by full name.
    """
    last = latest_per_key(changes, "file_path", ["seq"], ["deleted", "content", "language"]).persist()
    try:
        touched, files = last.select(F.col("file_path").alias("tp")), last.where("NOT deleted").select("file_path", "content", "language")
        before, edges = store.read("symbols"), store.read("relationships")
        gone = before.join(touched, F.col("file_path") == F.col("tp"), "left_semi").select(F.col("id").alias("gid"), F.col("full_name").alias("gname"))
        kept = before.join(touched, F.col("file_path") == F.col("tp"), "left_anti")
        fresh = with_symbol_ids(extract_symbols(files))
        after = kept.unionByName(fresh)
        own = edges_of(extract_references(files), fresh, after)
        alive = edges.join(gone.select("gid"), F.col("source_symbol_id") == F.col("gid"), "left_anti")
        moved = gone.join(fresh.select(F.col("id").alias("nid"), F.col("full_name").alias("nname")), F.col("gname") == F.col("nname")).groupBy("gid").agg(F.min("nid").alias("nid"))
        stay = alive.join(gone.select("gid"), F.col("target_symbol_id") == F.col("gid"), "left_anti").select("source_symbol_id", "target_symbol_id", "relationship_type")
        follow = alive.join(moved, F.col("target_symbol_id") == F.col("gid")).select("source_symbol_id", F.col("nid").alias("target_symbol_id"), "relationship_type")
        every = stay.unionByName(follow).unionByName(own.select("source_symbol_id", "target_symbol_id", "relationship_type")).distinct()
        chunks = store.read("chunks").join(touched, F.col("file_path") == F.col("tp"), "left_anti")
        new_chunks = embedded(symbol_chunks(files, fresh), store)
        store.write("chunks", chunks.unionByName(new_chunks))
        store.write("relationships", every.select(F.concat("source_symbol_id", F.lit("->"), "target_symbol_id", F.lit(":"), "relationship_type").alias("id"), "*"))
        store.write("symbols", after)
    finally:
        last.unpersist()


def watch(changes: DataFrame, store: SnapshotStore, checkpoint: str, quiet: str = "1 second") -> StreamingQuery:
    """Apply a stream of changes to the store, in batches at least ``quiet`` apart."""
    return changes.writeStream.foreachBatch(lambda batch, _: apply_changes(batch, store)).option("checkpointLocation", checkpoint).trigger(processingTime=quiet).start()


def upsert_stream(spark: SparkSession, source: DataFrame, key: str, order: list[str], values: list[str], path: str, checkpoint: str, after_batch: Callable[[int], None] | None = None) -> DataFrame:
    """Drain a stream into a last-wins table under ``path`` and return it.

    Every batch writes a new snapshot, named by its number, from the newest
    complete one of a lower number: a replayed batch overwrites only its own, and
    a restart goes on from what is there.
    """
    schema = f"{key} {source.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in dict.fromkeys(order + values))

    def apply(batch: DataFrame, n: int) -> None:
        cols = list(dict.fromkeys(order + values))
        new = latest_per_key(batch, key, order, cols)
        before = [v for v in versions(spark, path) if v < n]
        if before:  # an older event that arrives late must not win
            new = latest_per_key(spark.read.schema(schema).parquet(f"{path}/{before[-1]}").unionByName(new), key, order, cols)
        new.write.mode("overwrite").parquet(f"{path}/{n}")
        if after_batch:
            after_batch(n)

    source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{done[-1]}").select(key, *values) if done else spark.createDataFrame([], schema).select(key, *values)


__all__ = ["apply_changes", "edges_of", "index_files", "latest_per_key", "upsert", "upsert_stream", "watch"]
