"""What the vector operators share: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Vectors that are null, empty, zero or hold null or non-finite components take no part."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def sizes(vectors: DataFrame) -> list[int]:
    """The different numbers of components; vectors of one number are compared with one another only."""
    return [r.n for r in vectors.groupBy(F.size("embedding").alias("n")).agg(F.lit(1)).orderBy("n").collect()]


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """A column of lists of that size as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def exact_dots(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same for the same values wherever they stand, unlike a matrix product's."""
    return (one * two).sum(axis=1)
