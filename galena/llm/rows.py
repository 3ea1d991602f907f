"""Telling rows of documents apart without an identifier of their own.

A row is known by (doc_id, tag), tag being a hash of its text; rows that agree
in both are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"], F.length(docs["text"]))


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, tag) is in ``keys`` (unique; doc_id, tag, copies), one per key.

    Columns of ``docs`` may have any names. Only keys with several copies are
    grouped, after the others have gone.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("doc_id"), tag(docs).alias("tag"))
    named = keys.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), (F.col("copies") > 1).alias("_many"))
    both = rows.join(named, rows["doc_id"].eqNullSafe(named["_id"]) & rows["tag"].eqNullSafe(named["_tag"]))
    once = both.filter(~F.col("_many")).select("doc.*")
    again = both.filter("_many").groupBy("_id", "_tag").agg(F.first("doc").alias("doc")).select("doc.*")
    return once.unionByName(again)


def frequent(keys: DataFrame, room: int) -> DataFrame:
    """(key, n) of values that come up more often in ``keys`` (key: array<long>) than ``room`` times and 1 in 100,000; n is about how often, at least half.

    A value is counted in partitions that have at least ``least`` of it, which
    any one that frequent has in some. At most 200,000 rows, so they may be
    broadcast.
    """
    total = keys.agg(F.coalesce(F.sum(F.size("key").cast("long")), F.lit(0))).first()[0]
    room, parts = max(room, total // 100_000), max(1, keys.rdd.getNumPartitions())
    least = max(2, room // (2 * parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.empty(0, np.int64), *(np.asarray(b.column("key").flatten()) for b in batches)]
        key, count = np.unique(np.concatenate(own), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(x[count >= least]) for x in (key, count)], names=["key", "n"])

    counted = keys.select("key").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") > room // 2)
