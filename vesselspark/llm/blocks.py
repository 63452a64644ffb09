"""Vectors fit for blocks of matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` with doubles: one row per id, ids and vectors neither null, no component null or not finite, not
    all zero. Of rows that repeat an id the least vector counts."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return base.where(F.col("id").isNotNull() & fine).groupBy("id").agg(F.min("vector").alias("vector"))


def as_matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Rows of numbers, each row's bytes a value of the column."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1) if values else np.empty((0, 0), kind)


def as_bytes(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


def pieces(n: int, size: int) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, min(n, at + size))
