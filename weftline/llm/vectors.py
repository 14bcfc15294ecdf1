"""What the operators on vectors share: which rows take part, and arrays of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def width_of(rows: DataFrame, vector: str) -> int | None:
    """The length all vectors share, or None without a row; other lengths are refused."""
    ends = rows.agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most")).first()
    if ends["least"] != ends["most"]:
        raise ValueError(f"vectors of {ends['least']} to {ends['most']} components; one length is asked for")
    return ends["least"]


def matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column without nulls, as an array of ``width`` columns."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.Array:
    """The reverse of ``matrix``."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))
