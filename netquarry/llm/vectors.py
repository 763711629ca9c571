"""Embedding columns: which rows take part, and blocks of rows as one binary matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """A vector that is not null or empty and holds only finite components."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(x.cast("double"), F.lit(0.0))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.ChunkedArray, dim: int, dtype: str) -> np.ndarray:
    """A list column of equally long rows as (rows, dim)."""
    flat = column.combine_chunks().flatten()
    return np.asarray(flat).astype(dtype).reshape(-1, dim)
