"""What the operators on embeddings share: which vectors count, and matrices from Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str | Column) -> Column:
    """True where the vector is there, has entries, and each of them is a finite number; never NULL."""
    v = F.col(vector) if isinstance(vector, str) else vector
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & whole, F.lit(False))


def doubles(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.cast("array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without NULLs, all of one length, as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    """The reverse of ``matrix``."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()))
