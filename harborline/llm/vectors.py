"""Vectors of an Arrow list column as matrices of whole numbers."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers are held within this bound, so that sums over a partition fit 64 bits.
BOUND = 1 << 40


def width_of(vectors: DataFrame, column: str) -> int:
    """The length of the longest vector (0: there is none); shorter ones count as ending in zeros."""
    return vectors.agg(F.max(F.size(column)).alias("n")).first()["n"] or 0


def finite_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of finite entries, and those vectors as doubles, ``width`` entries each."""
    n = len(column)
    sizes = np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64)
    flat = column.flatten()
    flat = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is NaN
    row = np.repeat(np.arange(n), sizes)
    bad = np.bincount(row, ~np.isfinite(flat), n) > 0
    kept = np.flatnonzero(~bad & np.asarray(column.is_valid()))
    full = np.zeros((n, width))
    full[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return kept, full[kept]


def floors(values: np.ndarray, scale: int, bound: int = BOUND) -> np.ndarray:
    """floor(scale * value) as 64-bit integers, held within ``bound``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -bound, bound).astype(np.int64)
