"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """True for a vector that is there, with components that are all there and finite."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ((v - v) == 0)), F.lit(False))


def dimension(df: DataFrame, vec_col: str) -> int:
    """The commonest length of a finite vector, the smaller of two that are as common; 0 if there is none."""
    n = df.where(finite(F.col(vec_col)) & (F.size(vec_col) > 0)).groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return n["n"] if n else 0


def matrix(col: pa.Array | pa.ChunkedArray, d: int, dtype: type) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype).reshape(-1, d)
