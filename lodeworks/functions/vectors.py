"""Vector expressions and the n-gram embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

DIM = 1536


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def literal(vector: list[float]) -> Column:
    """A vector as one folded literal."""
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a side is null or has no length."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def _fused(a: Column, b: Column) -> Column:
    """Sum of products in single precision, each added without rounding before: products of floats are exact in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("float"), lambda acc, x: (acc + x).cast("float"))


def cosine_single(a: Column, b: Column) -> Column:
    """``cosine`` of float vectors in single precision, step by step as SQL's list_cosine_similarity of FLOAT[], widened to double.

    Where the product of the squared lengths is no normal float, it is computed in double.
    """
    parts = F.array(F.struct(_fused(a, b).alias("dot"), (_fused(a, a) * _fused(b, b)).alias("square")))
    ratio = lambda x: (x["dot"] / F.sqrt(x["square"]).cast("float")).cast("float").cast("double")
    found = F.transform(parts, lambda x: F.when((x["square"] >= 2.0**-126) & (x["square"] < float("inf")), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(x)))))[0]
    return F.coalesce(found, cosine(a, b))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def embed(text: str | None, dim: int = DIM) -> np.ndarray:
    """Feature-hashed 2-, 3- and 4-grams of the lower-case text, unit length; zero for texts of one letter or none."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out, gram = np.zeros(dim), codes
    for n in (2, 3, 4):
        if len(codes) < n:
            break
        gram = _mix(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :])  # of n letters, from that of n - 1
        sign = 1.0 - 2.0 * (gram >> np.uint64(63)).astype(float)
        out += np.bincount((gram % np.uint64(dim)).astype(np.int64), sign, dim)
    length = float(np.sqrt((out * out).sum()))
    return (out / length if length else out).astype(np.float32)


def embed_column(text: Column, dim: int = DIM) -> Column:
    """embed() over Arrow batches; each text is hashed as one array."""
    session = SparkSession.getActiveSession()
    if session:
        ship(session)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embed(t, dim))

    return run(text)
