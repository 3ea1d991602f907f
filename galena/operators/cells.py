"""Cells of vectors around pivots, for exact joins of vectors that are near each other.

A vector's home is the cell of its nearest pivot. Two vectors of different
homes that lie within a distance have the plane between the two pivots between
them, so each is within that distance of the plane. A vector therefore visits
the cells whose plane is in its reach and no others; of two cells one is
chosen to receive the other's visitors, so a pair meets once.

Vectors are not sent to those they meet: they lie in files of the shared
folder, by groups of cells, and a task reads the two groups it compares. Disk
and shuffles are in proportion to the vectors, however many groups meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.session import scratch_folder, written
from galena.sources.files import file_system, put

#: Distances err by less than this part of the squared lengths that enter them.
SLACK = 1e-9
#: Groups that all vectors are cut into, unless that makes them smaller than a block or larger than ROOM bytes of doubles.
GROUPS, ROOM = 64, 32 * 1024 * 1024


def gaps_of(pivots: np.ndarray) -> np.ndarray:
    """Distances between all of ``pivots``, never too large by more than rounding."""
    length = (pivots * pivots).sum(axis=1)
    return np.sqrt(np.maximum(length[:, None] + length - 2 * (pivots @ pivots.T), 0))


def powers(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances of each of ``x`` from each of ``pivots``, less the squared length of x."""
    return (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)


def homes_and_visits(x: np.ndarray, reach: np.ndarray, pivots: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each of ``x``, and a table of truth values: which cells it visits.

    ``reach`` is how far from each the vectors it is to meet may be. Values
    that are not numbers exclude nothing.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        power = powers(x, pivots)
        home = power.argmin(axis=1)
        beyond = power - np.take_along_axis(power, home[:, None], axis=1)
        slack = SLACK * ((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1).max())
        far = beyond - slack > 2 * gaps[home] * reach[:, None]
    cell = np.arange(len(pivots))
    odd = (home[:, None] + cell) % 2 == 1
    receives = odd == (home[:, None] < cell)
    return home, ~far & receives & (home[:, None] != cell)


def choose_pivots(rows: DataFrame, sizes: DataFrame, block: int, most: int) -> dict[tuple[str, int], np.ndarray]:
    """Pivots of each (model_id, dimensions) of more than ``block`` rows: a sample by a hash of id.

    About one for ``block`` rows; at most ``most`` for all keys together, dealt
    by their share of all rows, so that is what the driver holds.
    """
    key = ["model_id", "dimensions"]
    whole = sizes.agg(F.sum("n").alias("whole"))
    wanted = F.least(F.ceil(F.col("n") / block), F.floor(most * (F.col("n") / F.col("whole"))))
    some = sizes.crossJoin(F.broadcast(whole)).select(*key, "n", wanted.alias("wanted")).filter("wanted >= 2")  # ``whole`` is one row
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40)
    drawn = rows.join(some, key).withColumn("place", place * F.col("n") / F.col("wanted")).filter("place < 1").orderBy("place", "id").limit(most)
    pivots: dict[tuple[str, int], list] = {}
    for r in drawn.select(*key, "embedding").collect():
        pivots.setdefault((r.model_id, r.dimensions), []).append(r.embedding)
    found = {k: np.unique(np.array(v, np.float64), axis=0) for k, v in pivots.items()}
    return {k: v[np.isfinite(v).all(axis=1)] for k, v in found.items() if np.isfinite(v).all(axis=1).sum() > 1}


def near(x: np.ndarray, reach: np.ndarray, home: int, other: int, pivots: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Which of ``x``, of the cell ``home``, have the plane between it and the cell ``other`` in reach."""
    two = [home, other]
    own, visits = homes_and_visits(x, reach, pivots[two], gaps[np.ix_(two, two)])
    return visits[:, 1] | (own == 1)  # on the plane, but for rounding


def placed(rows: DataFrame, pivots: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """``rows`` (model_id, dimensions, id, embedding, reach) with ``home``."""
    keep = ["model_id", "dimensions", "id", "embedding", "reach"]
    schema = rows.select(*keep, F.lit(0).alias("home")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            home = np.zeros(len(frame), np.int32)
            for k, at in frame.groupby(["model_id", "dimensions"], sort=False).indices.items():
                for s in range(0, len(at) if k in pivots else 0, 512):  # bounds the table of distances
                    part = at[s : s + 512]
                    x = np.stack(frame["embedding"].to_numpy()[part]).astype(np.float64)
                    with np.errstate(invalid="ignore", over="ignore"):
                        home[part] = powers(x, pivots[k]).argmin(axis=1)
            yield frame[keep].assign(home=home)

    return rows.mapInPandas(run, schema)


@dataclass
class Group:
    """Vectors of one file, by cell: ``parts`` are (cell, first, end) of at most a block each."""

    ids: np.ndarray
    labels: np.ndarray
    reach: np.ndarray
    x: np.ndarray
    parts: list[tuple[int, int, int]]


def read_group(path: str, block: int) -> Group:
    store, own = file_system(path)
    with store.open_input_file(own) as source:
        found = np.load(BytesIO(source.read()))
    home = found["home"]
    cuts = np.flatnonzero(np.diff(home, prepend=-1)).tolist() + [len(home)]
    parts = [(int(home[a]), s, min(s + block, b)) for a, b in zip(cuts, cuts[1:], strict=False) for s in range(a, b, block)]
    return Group(found["id"], found["label"], found["reach"], found["embedding"].astype(np.float64), parts)


def group_size(sizes: DataFrame, block: int) -> int:
    """Rows of a group, for ``sizes`` (model_id, dimensions, n)."""
    n, most = sizes.agg(F.sum("n"), F.max("dimensions")).first()
    return max(1, block, min(-(-(n or 0) // GROUPS), ROOM // (8 * max(most or 1, 1))))


def grouped(cells: DataFrame, size: int) -> DataFrame:
    """(model_id, dimensions, i, path): files of about ``size`` rows of :func:`placed`, with their label if there, else their id.

    Cells lie one after the other, so a group is of few cells, and a cell that
    is larger than a group is dealt over several by a hash of id.
    """
    key = ["model_id", "dimensions"]
    folder, labelled = f"{scratch_folder(cells.sparkSession)}/{uuid4().hex}", "label" in cells.columns
    counts = cells.groupBy(*key, "home").agg(F.count(F.lit(1)).alias("n"))
    starts = written(counts.withColumn("start", F.sum("n").over(Window.partitionBy(*key).orderBy("home")) - F.col("n")))  # a row for each pivot and key
    place = F.col("start") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("n"))
    dealt = cells.join(starts, [*key, "home"]).withColumn("i", F.floor(place / size).cast("long")).drop("n", "start")

    def put_away(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["home", "id"], ignore_index=True)
        data, path = BytesIO(), f"{folder}/{uuid4().hex}.npz"
        np.savez(data, id=frame["id"], label=frame["label" if labelled else "id"], home=frame["home"], reach=frame["reach"], embedding=np.stack(frame["embedding"].to_numpy()))
        store, own = file_system(path)
        store.create_dir(own.rpartition("/")[0], recursive=True)
        put(store, own, data.getvalue())
        return pd.DataFrame({"model_id": frame["model_id"].iloc[:1], "dimensions": frame["dimensions"].iloc[:1], "i": frame["i"].iloc[:1], "path": path})

    return written(dealt.groupBy(*key, "i").applyInPandas(put_away, "model_id string, dimensions int, i long, path string"))


def meetings(groups: DataFrame) -> DataFrame:
    """(model_id, dimensions, i, j, path, other, others): each of :func:`grouped` meets itself and every later one of its key, of which it has ``others`` with itself."""
    key = ["model_id", "dimensions"]
    mine = groups.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return mine.join(groups.select(*key, F.col("i").alias("j"), F.col("path").alias("other")), key).filter("i <= j")


def is_early(few: int = 4) -> Column:
    """Whether a meeting is one of a group with itself, or of about ``few`` that each group has besides."""
    some = F.pmod(F.xxhash64("model_id", "dimensions", "i", "j"), F.greatest(F.floor(F.col("others") / few), F.lit(1))) == 0
    return (F.col("i") == F.col("j")) | some
