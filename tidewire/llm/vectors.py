"""Embedding columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Vectors without null or non-finite components, and not zero."""
    v = F.col(column)
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & real & F.exists(v, lambda x: x != 0), F.lit(False))


def one_each(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector), usable vectors only; of rows with one id the smallest vector counts; null ids take no part."""
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & usable("vector")).groupBy("id").agg(F.min("vector").alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype=float).tobytes()


def unblob(b: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(b, float).reshape(rows, -1)
