"""Vector search: exact scoring, filters before the top-k, ties by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import vectors


def scored(df: DataFrame, query: list[float], vector_col: str = "embedding") -> DataFrame:
    """Adds similarity (cosine) and distance (1 - similarity); a vector of another dimension is an error.

    Float vectors are scored in single precision, as SQL scores FLOAT[], all others in double.
    """
    v = F.col(vector_col)
    checked = F.when(v.isNull() | (F.size(v) == len(query)), v).otherwise(F.raise_error(F.concat(F.lit(f"expected {len(query)} dimensions, got "), F.size(v))))
    kind = df.schema[vector_col].dataType
    cosine = vectors.cosine_single if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else vectors.cosine
    return df.withColumn("similarity", cosine(checked, vectors.literal(query))).withColumn("distance", 1 - F.col("similarity"))


def top_k(df: DataFrame, query: list[float], k: int = 10, id_col: str = "id", vector_col: str = "embedding", where: Column | None = None, min_similarity: float | None = None, most: int | None = None) -> DataFrame:
    """The k most similar rows that pass ``where`` and ``min_similarity``; k is at most ``most``."""
    df = df.where(where) if where is not None else df
    found = scored(df, query, vector_col)
    if min_similarity is not None:
        found = found.where(F.col("distance") <= 1 - min_similarity)
    return found.orderBy(F.desc("similarity"), id_col).limit(min(k, most) if most else k)


def rerank(rows: DataFrame, chunks: DataFrame, query: list[float], id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """rows(id, ...) ordered by the similarity of their chunk; rows without a chunk score 0."""
    s = scored(chunks.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v")), query, "__v").select("__id", "similarity")
    out = rows.join(s, rows[id_col] == F.col("__id"), "left").drop("__id").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return out.orderBy(F.desc("similarity"), id_col)
