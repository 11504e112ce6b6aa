"""Vectors of a table as blocks of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not zero, and has finite components only."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(e.isNotNull() & fine & F.exists(e, lambda x: x != 0))


def width_of(vectors: DataFrame) -> int:
    """Length of the vectors, which is one for all; others are refused."""
    low, high = vectors.select(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components")
    return low or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
