"""What the vector operators share: which vectors take part, and vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, every component present and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An array column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True) if len(rows) else rows


def length_of(df: DataFrame, vector_col: str) -> int:
    """The greatest length of a usable vector; 0 without any."""
    return df.where(usable(F.col(vector_col))).agg(F.max(F.size(vector_col))).first()[0] or 0


def taking_part(df: DataFrame, id_col: str, vector_col: str, *keep: Column, dims: int | None = None) -> DataFrame:
    """(id, v, ...) of usable vectors of `dims` components, by default the greatest length there is; others can't be compared."""
    most = length_of(df, vector_col) if dims is None else dims
    return df.where(usable(F.col(vector_col)) & (F.size(vector_col) == most)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), *keep)
