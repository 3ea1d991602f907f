"""Rows of integer vectors, made from embeddings by scaling and rounding down."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled entries beyond this stop there, so that differences of two fit in 64 bits.
MOST = float(1 << 61)


def finite(vector: Column) -> Column:
    """Whether ``vector`` is there and has neither null nor non-finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, by: int, shift: int = 0) -> Column:
    """floor(by * entry) + shift of every entry, as array<long>."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * by, F.lit(MOST)), F.lit(-MOST))) + F.lit(shift).cast("long"))


def integer_rows(vectors: DataFrame, by: int, shift: int = 0) -> DataFrame:
    """(vec_id, x) of the rows of ``vectors`` (vec_id, embedding) whose vector is finite."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding"))
    return rows.filter(finite(F.col("embedding"))).select("vec_id", scaled(F.col("embedding"), by, shift).alias("x"))


def matrices(batch: pa.RecordBatch, name: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of int64) of the vectors of each length in ``batch``, empty vectors left out."""
    lists = batch.column(name)
    ends = lists.offsets.to_numpy().astype("int64")
    values, lengths = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        yield at, values[ends[at][:, None] + np.arange(d)]


def square_sums(rows: np.ndarray) -> np.ndarray:
    """Exact sums of squares along the rows of an int64 matrix: int64 where all fit, else Python integers."""
    estimate = np.square(rows.astype("float64")).sum(axis=1)
    if not len(rows) or estimate.max() < 2.0**62:
        return np.square(rows).sum(axis=1)
    return np.square(rows.astype(object)).sum(axis=1)


def longs(values: np.ndarray) -> pa.Array:
    """Integers as long; null where they don't fit."""
    if values.dtype != object:
        return pa.array(values.astype("int64"), pa.int64())
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())


def halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low 32 bits, which sums of 2**31 rows can't overflow."""
    return rows >> 32, rows & 0xFFFFFFFF
