"""Whole-number vectors for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether the vector and all its components are known and finite (NaN
    sorts above infinity in Spark)."""
    known = lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, known), F.lit(False))


def scaled_floor(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component ``x``, taken as a double."""
    return F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``id``, ``label`` and ``q``, the whole-number components, of the rows
    whose vector and components are known and finite."""
    vector = F.col(f"`{vector_col}`")
    return df.filter(finite(vector)).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), scaled_floor(vector, scale).alias("q")
    )


def stack(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists as a matrix, shorter lists filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def lists(matrix: np.ndarray) -> pa.ListArray:
    """A matrix as a column of lists."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.reshape(-1), pa.int64()))


def largest(df: DataFrame, column: str = "q") -> tuple[int, int]:
    """The longest vector's length and the largest absolute component; zeros
    where there is none."""
    size = F.array_max(F.transform(F.col(column), F.abs))
    row = df.agg(F.max(F.size(column)).alias("width"), F.max(size).alias("most")).first()
    return int(row["width"] or 0), int(row["most"] or 0)


def within(bound: int, limit: int, what: Iterable[str]) -> None:
    """Raise where exact 64-bit sums cannot hold ``bound``."""
    if bound >= limit:
        raise ValueError(f"{' '.join(what)}: components are too large for exact sums of 64 bits")
