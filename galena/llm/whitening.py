"""Whitening of embeddings by streaming moments and a symmetric QR eigen-solve.

Every task folds its vectors one by one into a mean and a sum of outer
products of deviations (Welford's rank-one update). States of tasks are merged
a few at a time, in rounds, by the parallel update formula; one state of each
vector length reaches the driver, d * d numbers. There V is brought to
tridiagonal form by reflections and to its eigenvalues by implicit QR steps
with Wilkinson shifts.

Each distinct vector counts once. Copies are dropped before the shuffle as
well, so a vector with a third of all rows is one row of each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import copysign, hypot

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import batches_of, written
from galena.llm.integer_vectors import halves, integer_rows, longs, matrices, square_sums

SCALE, SHIFT = 64, 1_000_000
STATE = "d int, part int, n long, high binary, low binary, mean binary, spread binary"


class Moments:
    """Count, exact sums, mean and sum of outer products of deviations of vectors of one length."""

    def __init__(self, d: int):
        self.n, self.mean, self.spread = 0, np.zeros(d), np.zeros((d, d))
        self.high, self.low = np.zeros(d, "int64"), np.zeros(d, "int64")
        self.room = np.empty((d, d))

    def add(self, rows: np.ndarray) -> None:
        """Fold rows in, one rank-one update each."""
        if rows.dtype.kind == "i":
            high, low = halves(rows)
            self.high += high.sum(axis=0)
            self.low += low.sum(axis=0)
        for row in rows.astype("float64"):
            self.n += 1
            delta = row - self.mean
            self.mean += delta / self.n
            np.multiply((delta * ((self.n - 1) / self.n))[:, None], delta, out=self.room)
            self.spread += self.room

    def merge(self, other: Moments) -> None:
        """Take another state in, as if its rows had been folded in here."""
        n = self.n + other.n
        if other.n:
            delta = other.mean - self.mean
            self.spread += other.spread + np.outer(delta, delta) * (self.n * other.n / n)
            self.mean += delta * (other.n / n)
            self.n, self.high, self.low = n, self.high + other.high, self.low + other.low

    @property
    def sums(self) -> list[int]:
        return [(int(h) << 32) + int(x) for h, x in zip(self.high, self.low, strict=True)]

    def row(self, part: int) -> tuple:
        return len(self.mean), part, self.n, self.high.tobytes(), self.low.tobytes(), self.mean.tobytes(), self.spread.tobytes()

    @classmethod
    def of(cls, row) -> Moments:
        own = cls(row.d)
        own.n, own.mean, own.spread = int(row.n), np.frombuffer(row.mean).copy(), np.frombuffer(row.spread).reshape(row.d, row.d).copy()
        own.high, own.low = np.frombuffer(row.high, "int64").copy(), np.frombuffer(row.low, "int64").copy()
        return own


def moments(rows: DataFrame, fan_in: int = 16) -> dict[int, Moments]:
    """Moments of column x of ``rows`` (a table; array<long> or array<double>), by vector length."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Moments] = {}
        for batch in batches:
            for _, x in matrices(batch):
                own.setdefault(x.shape[1], Moments(x.shape[1])).add(x)
        part = TaskContext.get().partitionId()
        for m in own.values():  # one at a time: states of many lengths need not fit side by side
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(m.row(part), [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=["d", "part", "n", "high", "low", "mean", "spread"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        first, *rest = frame.sort_values("part").itertuples()
        own = Moments.of(first)
        for other in rest:
            own.merge(Moments.of(other))
        return pd.DataFrame([own.row(first.part // fan_in)], columns=["d", "part", "n", "high", "low", "mean", "spread"])

    states, parts = rows.select("x").mapInArrow(fold, STATE), max(1, rows.rdd.getNumPartitions())
    while parts > 1:
        states = states.withColumn("_to", F.floor(F.col("part") / fan_in)).groupBy("d", "_to").applyInPandas(merged, STATE)
        parts = -(-parts // fan_in)
    return {r.d: Moments.of(r) for r in states.collect()}


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q' a q tridiagonal, by Householder reflections."""
    a, q = a.copy(), np.eye(len(a))
    least = np.abs(a).sum() * 1e-30
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        if np.abs(u).max() <= least:  # nothing there but what rounding left
            a[k + 1 :, k] = a[k, k + 1 :] = 0
            continue
        edge = -copysign(np.linalg.norm(u), u[0])
        u[0] -= edge
        u /= np.linalg.norm(u)
        p = a[k + 1 :, k + 1 :] @ u
        w = 2 * (p - (u @ p) * u)
        a[k + 1 :, k + 1 :] -= np.outer(u, w) + np.outer(w, u)
        a[k + 1, k] = a[k, k + 1] = edge
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of a symmetric matrix; of each, the largest entry is positive."""
    diagonal, edge, q = tridiagonal(np.asarray(a, "float64"))
    rows, eps, scale = q.T.copy(), np.finfo(float).eps, np.abs(a).sum() * 1e-24
    d, e = diagonal.tolist(), [*edge.tolist(), 0.0]
    high = len(d) - 1
    for _ in range(60 * len(d) + 1):
        for k in range(high):
            if abs(e[k]) <= eps * (abs(d[k]) + abs(d[k + 1])) + scale:
                e[k] = 0.0
        while high > 0 and e[high - 1] == 0.0:
            high -= 1
        if high <= 0:
            break
        low = high - 1
        while low > 0 and e[low - 1] != 0.0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + copysign(hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            upper, lower, side = d[k], d[k + 1], e[k]
            d[k] = c * c * upper + 2 * c * s * side + s * s * lower
            d[k + 1] = s * s * upper - 2 * c * s * side + c * c * lower
            e[k] = c * s * (lower - upper) + (c * c - s * s) * side
            x = e[k]
            if k < high - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            rows[k], rows[k + 1] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    else:
        raise ArithmeticError("the QR steps did not converge")
    values = np.array(d)
    order = np.argsort(-values, kind="stable")
    values, rows = values[order], rows[order]
    top = rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)] if len(rows) else np.empty(0)
    return values, rows * np.where(top < 0, -1.0, 1.0)[:, None]


@dataclass
class Space:
    """What whitens vectors of one length: count, exact sums, axes over root eigenvalues, shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: int64 where all fit, else Python integers."""
        mean = np.array([s / self.n for s in self.sums])
        if not len(x) or np.abs(x - mean).max() * self.n < 2.0**62:  # what wraps in the products wraps back
            low = np.array([s & 0xFFFFFFFFFFFFFFFF for s in self.sums], "uint64")
            return (x.astype("uint64") * np.uint64(self.n) - low).view("int64")
        return x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype("float64") @ self.axes.T


class Whitening:
    """Whitening fitted on the distinct vectors of ``vectors`` (vec_id, embedding).

    ``components`` bounds the axes of each vector length; those whose variance
    is zero but for rounding have no unit scale and are left out.
    """

    def __init__(self, vectors: DataFrame, components: int = 16, scale: int = SCALE, shift: int = SHIFT):
        self.scale, self.shift, self.spaces = scale, shift, {}
        fit = written(integer_rows(vectors, scale, shift).select("x").distinct())
        for d, m in moments(fit).items():
            v = m.spread / m.n
            values, rows = symmetric_qr((v + v.T) / 2)
            keep = values[:components] > values[0] * d * np.finfo(float).eps if d else np.empty(0, bool)
            values, rows, trace = values[:components][keep], rows[:components][keep], float(np.trace(v))
            self.spaces[d] = Space(m.n, m.sums, rows / np.sqrt(values)[:, None], [float(e / trace) for e in values])
        self.identity_error = self._identity_error(fit)

    def _identity_error(self, fit: DataFrame) -> float:
        """Largest absolute entry of the covariance of the whitened fit list minus the identity, of all lengths.

        The second pass measures what the tasks make, not the model.
        """
        spaces = self.spaces

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, x in matrices(batch):
                    own = spaces[x.shape[1]]
                    values = list(own.project(own.centred(x)))
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["d", "x"])

        worst = 0.0
        whitened = written(batches_of(fit, run, "d int, x array<double>"))
        for d, own in self.spaces.items():
            if len(own.axes):
                m = moments(whitened.filter(F.col("d") == d))[len(own.axes)]
                worst = max(worst, float(np.abs(m.spread / m.n - np.eye(len(own.axes))).max()))
        return worst

    def transform(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, n, deviation, deviation_digits, whitened, explained) of each row with a finite, non-empty vector.

        deviation is the sum of squares of n * x - sums, null beyond a long;
        deviation_digits has it in decimal at any size. whitened and explained
        are arrays, one entry an axis.
        """
        spaces, schema = self.spaces, "vec_id long, n long, deviation long, deviation_digits string, whitened array<double>, explained array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x in matrices(batch):
                    own = spaces[x.shape[1]]
                    centred = own.centred(x)
                    total = square_sums(centred) if centred.dtype != object else np.square(centred).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(pa.array(at)), pa.array([own.n] * len(x), pa.int64()), longs(total), pa.array([str(v) for v in total.tolist()]), pa.array(list(own.project(centred)), pa.list_(pa.float64())), pa.array([own.explained] * len(x), pa.list_(pa.float64()))],
                        names=["vec_id", "n", "deviation", "deviation_digits", "whitened", "explained"],
                    )

        return batches_of(integer_rows(vectors, self.scale, self.shift), run, schema)


def whitening_report(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Whitened coordinates of ``vectors`` (vec_id, embedding), one row for each vector and component.

    Returns vec_id, component (from 1, by falling variance), n, deviation,
    whitened, explained, identity_error and deviation_digits. Rows whose
    vector is null, or holds null or non-finite entries, go; so do empty
    vectors, which have no component. Vectors of each other length are a space
    of their own, with its own n and components; identity_error is the worst
    of all. Components without variance (constant vectors, fewer vectors than
    dimensions) are left out. Repeated rows count once in the fit and are
    returned each, as are null ids. Entries beyond 2**61 / 64 stop there. An
    empty table gives an empty result; further columns, of whatever names, are
    ignored.
    """
    model = Whitening(vectors, components)
    each = model.transform(vectors).select("vec_id", "n", "deviation", "deviation_digits", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "own"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("own.whitened").alias("whitened"), F.col("own.explained").alias("explained"), F.lit(model.identity_error).alias("identity_error"), "deviation_digits")
