"""Embedding columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled with zeros up to ``width`` (the longest one)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    ends = np.cumsum(lengths)
    for i, (end, n) in enumerate(zip(ends, lengths)):
        n_kept = min(n, width)
        out[i, :n_kept] = flat[end - n:end - n + n_kept]
    return out


def units(rows: np.ndarray) -> np.ndarray:
    """Each row divided by its length; scaled first, so that no square overflows."""
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0), 5e-324)
    return rows / np.maximum(np.sqrt((rows ** 2).sum(axis=1, keepdims=True)), 5e-324)
