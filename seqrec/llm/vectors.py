"""What the vector operators share: which vectors count, and Arrow list columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector_col: str) -> Column:
    """The vector with components in double precision."""
    return F.col(vector_col).cast("array<double>")


def finite(vector: str = "vec") -> Column:
    """True for vectors that hold components, none of them null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def of_commonest_length(rows: DataFrame, vector: str = "vec") -> tuple[DataFrame, int]:
    """Rows whose vector has the commonest length (the shorter on ties), and this length; 0 if there are no rows."""
    found = rows.groupBy(F.size(vector).alias("k")).count().orderBy(F.desc("count"), "k").head()
    if found is None:
        return rows, 0
    return rows.where(F.size(vector) == found["k"]), int(found["k"])


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as an Arrow list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if len(rows) else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), kind))
