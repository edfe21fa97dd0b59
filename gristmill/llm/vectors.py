"""Vectors as whole numbers, for the operators that promise exact sums and signs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
LIMIT = float(2**53)  # entries from here on have no whole number of 64 bits


def whole(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``x``, floor(256 * entry) of each entry, of the rows whose vector can be written so.

    Left out are null vectors and those that hold a null, a number that is not finite or one of 2^53 and more.
    """
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT))
    scaled: Column = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    return vectors.where(v.isNotNull() & ~bad).select(F.col(key), scaled.alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


def exact(x: np.ndarray, limit: int) -> np.ndarray:
    """``x``, as Python's numbers of any size if an entry reaches ``limit``."""
    if x.size and max(-int(x.min()), int(x.max())) >= limit:
        return x.astype(object)
    return x
