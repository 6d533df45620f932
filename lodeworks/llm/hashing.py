"""Vectorised hashing of word sequences, on numpy arrays of 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(31), np.uint64(29)
#: Words taken through numpy at once: bounds the memory of a Python worker.
CHUNK = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[0])) * _C
    return x ^ (x >> _S[1])


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a followed by b."""
    return mix(a * _A + b * _B)


def ngrams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all n consecutive entries, by doubling; empty if there are fewer."""
    if len(h) < n:
        return h[:0]
    power = mix(h + np.uint64(salt)) if salt else h
    acc, at, size = None, 0, 1
    while True:
        if n & size:
            part = power[n - at - size : len(power) - at] if acc is not None else power[n - size :]
            acc = part if acc is None else pair(part, acc)
            at += size
        if size * 2 > n:
            return acc
        power = pair(power[:-size], power[size:])
        size *= 2


def sliding(a: np.ndarray, w: int, f=np.minimum) -> np.ndarray:
    """f over each w consecutive entries."""
    if len(a) < w:
        return a[:0]
    size = 1
    while size * 2 <= w:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


def list_column(batch: pa.RecordBatch, name: str, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets from 0) of a list column without nulls."""
    col = batch.column(batch.schema.get_field_index(name))
    off = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return values.view(kind) if values.dtype.itemsize == 8 else values, off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many values, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def to_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
