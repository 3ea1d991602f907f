"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galena.session import shared_folder, written

__all__ = ["SPACE", "WORD", "array_sum", "batches_of", "checkpointed", "shared_folder", "table", "text_of", "written"]

#: One run of ASCII white space, and one word between such runs.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def batches_of(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = 1000, max_bytes: int = 1 << 24) -> DataFrame:
    """``df.mapInArrow(run, schema)`` on batches of at most ``rows`` rows and about ``max_bytes``, as texts can be long."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(rows, max_bytes * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, max(1, batch.num_rows), step):
                yield batch.slice(at, step)

    return df.mapInArrow(lambda batches: run(cut(batches)), schema)


def array_sum(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int, fan_in: int = 64) -> np.ndarray:
    """Sum of ``part`` (``size`` doubles) over all batches of ``rows``, a table; tasks' sums meet ``fan_in`` at a time."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                total += part(batch.slice(at, 2000))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sum"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for x in frame.sort_values("part")["sum"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // fan_in], "sum": [total.tobytes()]})

    sums, parts = rows.mapInArrow(fold, "part int, sum binary"), max(1, rows.rdd.getNumPartitions())
    while parts > fan_in:
        sums = sums.groupBy(F.floor(F.col("part") / fan_in).alias("_to")).applyInPandas(merged, "part int, sum binary")
        parts = -(-parts // fan_in)
    total = np.zeros(size)
    for r in sorted(sums.collect(), key=lambda r: r.part):
        total += np.frombuffer(r["sum"])
    return total
