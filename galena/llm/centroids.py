"""Exact integer clustering with float32 screening.

A round multiplies vectors and centroids in float32 and puts a rigorous
interval round each squared distance: a sum of d products, in any order and
with or without fused steps, is off by at most gamma(d) |x| |c|, with
gamma(d) = d u / (1 - d u) and u = 2**-24; two more roundings a product stand
for entries that float32 can't hold. A centroid whose interval lies wholly
above another's upper end is out. Where several are left, their distances are
computed with exact integers, and of equal ones the smallest number wins.

Rounds are passes over one table without a shuffle of vectors: each task sends
its centroids' counts and sums, at most k rows. Driver and closures hold the
centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import batches_of, written
from galena.llm.integer_vectors import halves, integer_rows, longs, matrices, square_sums

SCALE, SIZE, CENTROIDS, ROUNDS, SALT = 256, 64, 40, 5, "2:"
UNIT = 2.0**-24


def intervals(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |c|^2 - 2 x.c, a row for each of ``x``; what float32 can't hold is unbounded."""
    d = x.shape[1] + 2
    gamma = d * UNIT / (1 - d * UNIT)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (x.astype("float32") @ centroids.astype("float32").T).astype("float64")
        squares = np.square(centroids.astype("float64")).sum(axis=1)
        lengths = np.sqrt(np.square(x.astype("float64")).sum(axis=1))[:, None] * np.sqrt(squares)
        middle = squares - 2 * product
        # the double-precision steps here are off by less than 2**-40 of their terms
        radius = 2 * gamma * lengths * (1 + 2.0**-40) + (squares + 2 * np.abs(product)) * 2.0**-40
        low, high = middle - radius, middle + radius
    open_ = ~np.isfinite(middle) | ~np.isfinite(radius)
    low[open_], high[open_] = -np.inf, np.inf
    return low, high


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, exact squared distance) of each row of ``x``; both matrices int64."""
    low, high = intervals(x, centroids)
    short = low <= high.min(axis=1)[:, None]
    best = short.argmax(axis=1)
    row, number = np.nonzero(short & (short.sum(axis=1) > 1)[:, None])  # by row, then by number
    if len(row):
        exact = square_sums(x[row] - centroids[number])
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[starts, len(row)])))
        first = hits[np.unique(row[hits], return_index=True)[1]]
        best[row[first]] = number[first]
    return best, square_sums(x - centroids[best])


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of their salted ids, a (k or fewer) x d matrix.

    Rows without an id have no hash and begin no centroid, unless there are
    too few others; of equal ids the smaller vector comes first.
    """
    hashed = rows.select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"), "x")
    found = hashed.orderBy(F.col("hash").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in found], "int64").reshape(len(found), len(found[0].x) if found else 0)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor(sum / count) of their vectors; those without vectors stay."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = np.zeros(k, "int64"), np.zeros((k, d), "int64"), np.zeros((k, d), "int64")
        for batch in batches:
            for _, x in matrices(batch):
                best, _ = nearest(x, centroids)
                order = np.argsort(best, kind="stable")
                own, starts, n = np.unique(best[order], return_index=True, return_counts=True)
                count[own] += n
                for total, part in zip((high, low), halves(x[order]), strict=True):
                    total[own] += np.add.reduceat(part, starts, axis=0)
        at = np.flatnonzero(count)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(count[at]), pa.array(list(high[at]), kind), pa.array(list(low[at]), kind)], names=["cluster", "n", "high", "low"])

    parts = batches_of(rows, run, "cluster int, n long, high array<long>, low array<long>")
    each = parts.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "own"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = centroids.copy()
    for r in each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), wide("own.high").alias("high"), wide("own.low").alias("low")).collect():
        out[r.cluster, r["at"]] = ((int(r.high) << 32) + int(r.low)) // r.n
    return out


class Clustering:
    """``k`` centroids moved ``rounds`` times over the vectors of ``size`` entries of ``vectors`` (vec_id, embedding)."""

    def __init__(self, vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE, salt: str = SALT):
        self.rows = written(integer_rows(vectors.filter(F.size(vectors["embedding"]) == size), scale))
        self.centroids = first_centroids(self.rows, k, salt)
        for _ in range(rounds if len(self.centroids) else 0):
            self.centroids = moved(self.rows, self.centroids)

    def assigned(self) -> DataFrame:
        """(vec_id, cluster, distance): nearest centroid and exact squared distance, null beyond a long."""
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x in matrices(batch):
                    best, distance = nearest(x, centroids)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(best.astype("int32")), longs(distance)], names=["vec_id", "cluster", "distance"])

        return batches_of(self.rows, run, "vec_id long, cluster int, distance long")


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """Clusters of ``vectors`` (vec_id, embedding), one row for each vector that is kept.

    Returns vec_id, cluster, distance, cluster_inertia, inertia and
    centroid_sha256. Vectors that are null, of another size, or hold null or
    non-finite entries go. Repeated rows are kept each, as are null ids, which
    begin no centroid while there are others. Fewer vectors than centroids:
    each begins one. Entries beyond 2**61 / 256 stop there; distances and
    their sums beyond a long are null. An empty table gives an empty result;
    further columns, of whatever names, are ignored.
    """
    model = Clustering(vectors, **options)
    rows = written(model.assigned())
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("known"))
    found = {r.cluster: int(r.own) if r.n == r.known else None for r in sums.collect()}
    total = None if None in found.values() else sum(found.values())
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    named = [(k, fits(own), fits(total), hashlib.sha256(",".join(map(str, model.centroids[k].tolist())).encode()).hexdigest()) for k, own in found.items()]
    each = vectors.sparkSession.createDataFrame(named, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(each), F.col("cluster") == F.col("_cluster")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def report_sql(k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE, salt: str = SALT) -> str:
    """The report as SQL: all distances in exact integers, one pair of tables a round."""
    steps = [
        f"v0 AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings"
        f" WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM v0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS cluster, x FROM (SELECT sha256('{salt}' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"d{r} AS MATERIALIZED (SELECT r, cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v, c{r} AS c),"
            f"a{r} AS MATERIALIZED (SELECT r, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{r} GROUP BY r)"
        )
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT cluster, i, sum(v.x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (r), range(1, {size + 1}) AS t(i) GROUP BY cluster, i),"
                f"m{r} AS (SELECT cluster, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY cluster),"
                f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN m{r} AS m USING (cluster))"
            )
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, a.cluster::INTEGER AS cluster, a.distance::BIGINT AS distance,"
        " sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia,"
        f" sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN v USING (r) JOIN c{rounds} AS c ON a.cluster = c.cluster"
    )
