"""Machines over tables and over streams, with the same rows either way.

A table is sorted by key and time and folded as it streams by, so no key is
held in memory. A stream keeps a key's events until the watermark has passed
them, and takes them in time order then: batches, and order within the
allowed lateness, leave no mark on the result. Alarms are event-time timers.
A key whose machine is at rest has no state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from galena.session import shared_folder
from galena.streaming.machines import Machine, advance

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PACK = 1000  # events of a key that one row of its state holds
FILE = 100_000  # rows of a landed file, at least, where a batch has several


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _rows(events: DataFrame, keys: list[str], machine: Machine, ts: str, order: tuple[str, ...], *more: str) -> DataFrame:
    """Keys, time, and what the machine takes and events of one time go by, as JSON."""
    known = events.filter(F.col(ts).isNotNull())
    json_of = lambda names: F.to_json(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))) if names else F.lit("{}")
    return known.select(*keys, micros(ts).alias("fold_at"), json_of(machine.fields).alias("fold_event"), json_of(order).alias("fold_place"), *(F.col(c).alias(f"fold_order{k}") for k, c in enumerate(order)), *more)


def _values(text: str, n: int) -> tuple:
    own = json.loads(text)
    return tuple(own.get(f"c{k}") for k in range(n))


def _schema(events: DataFrame, keys: list[str], machine: Machine) -> StructType:
    own = StructType.fromDDL(f"at long, {machine.output}")
    return StructType([*(events.schema[k] for k in keys), *own.fields])


def _timed(out: DataFrame) -> DataFrame:
    return out.withColumn("at", F.timestamp_micros("at"))


def folded(events: DataFrame, keys: list[str], machine: Machine, ts: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, at, *output) of a table's events, those of a key by ``ts`` and then by ``order``; what waits at its end comes due.

    Events without a time are left out. A key's events are folded one after
    another by one task.
    """
    rows = _rows(events, keys, machine, ts, order).repartition(*keys).sortWithinPartitions(*keys, "fold_at", *(f"fold_order{k}" for k in range(len(order)))).select(*keys, "fold_at", "fold_event")
    schema, width, n = _schema(events, keys, machine), len(keys), len(machine.fields)
    kinds, names = to_arrow_schema(schema), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, out = None, None, []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], kinds)
            out.clear()
            return made

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(width + 2)), strict=True):
                key = row[:width]
                if state is None or key != own:
                    if state is not None:
                        out += [(*own, *r) for r in advance(machine, state, iter(()), 1 << 62)]
                    own, state = key, machine.start()
                out += [(*own, *r) for r in advance(machine, state, iter([(row[width], _values(row[-1], n))]), None)]
                if len(out) >= 10_000:
                    yield batch()
        if state is not None:
            out += [(*own, *r) for r in advance(machine, state, iter(()), 1 << 62)]
        yield batch()

    return _timed(rows.mapInArrow(run, schema))


class Fold(StatefulProcessor):
    """A machine as a stateful processor: events that the watermark has not passed, the machine's state, one timer."""

    def __init__(self, machine: Machine, names: list[str], order: int):
        self.machine, self.names, self.order = machine, names, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")  # JSON of up to PACK (at, place, event), as each row costs a call's work
        self.own = handle.getValueState("machine", "state string, timer long")

    def handleInputRows(self, key, rows, timerValues):
        return self.turn(key, [(r["fold_at"], r["fold_place"], r["fold_event"]) for r in rows if "fold_close" not in r or not r["fold_close"]], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self.turn(key, [], timerValues)

    def in_order(self, events: list) -> list:
        """``events`` by time; what those of one time go by is only read where there are several."""
        events.sort(key=itemgetter(0))
        out = []
        for _, own in groupby(events, itemgetter(0)):
            own = list(own)
            if len(own) > 1:
                own.sort(key=lambda r: [(x is not None, x) for x in _values(r[1], self.order)])
            out += own
        return out

    def turn(self, key, new: list[tuple], timer_values) -> Iterator[Row]:
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        saved = self.own.get()
        kept = [e for (text,) in self.waiting.get() for e in json.loads(text)] if saved else []  # what waits has a timer
        held = kept + new
        ready = self.in_order([r for r in held if r[0] <= passed])
        rest = [r for r in held if r[0] > passed]
        state = json.loads(saved[0]) if saved else self.machine.start()
        out = list(advance(self.machine, state, ((at, _values(event, len(self.machine.fields))) for at, _, event in ready), passed))
        alarm = min((t for t in (self.machine.due(state), *(r[0] for r in rest)) if t is not None), default=None)
        timer = -1 if alarm is None else -(-alarm // 1000)
        if saved and saved[1] not in (-1, timer):
            self.handle.deleteTimer(saved[1])
        if timer != -1 and (not saved or saved[1] != timer):
            self.handle.registerTimer(timer)
        packs = lambda rows: [(json.dumps(rows[k : k + PACK]),) for k in range(0, len(rows), PACK)]
        if len(rest) == len(held):  # none of those kept has gone
            if new:
                self.waiting.appendList(packs(new))
        elif rest:
            self.waiting.put(packs(rest))
        elif kept:
            self.waiting.clear()
        if timer == -1 and state == self.machine.start():
            self.own.clear()
        else:
            self.own.update((json.dumps(state), timer))
        make = Row(*self.names)
        for r in out:
            yield make(*key, *r)

    def close(self) -> None:
        pass


def folded_stream(events: DataFrame, keys: list[str], machine: Machine, ts: str = "ts", order: tuple[str, ...] = (), late: str = "10 seconds") -> DataFrame:
    """:func:`folded` of a stream: rows come when the watermark, ``late`` behind the latest event, has passed their time.

    Start the stream within :func:`rocks_state`, or in a session whose state
    store is RocksDB: timers need it. A column ``fold_close`` marks rows that move
    the watermark and are no events.
    """
    close = [c for c in ("fold_close",) if c in events.columns]
    own = events.withColumn("fold_ts", F.col(ts).cast("timestamp")).withWatermark("fold_ts", late)
    rows = _rows(own, keys, machine, ts, order, "fold_ts", *close).drop(*(f"fold_order{k}" for k in range(len(order))))
    schema = _schema(events, keys, machine)
    out = rows.groupBy(*keys).transformWithState(Fold(machine, schema.names, len(order)), schema, "Append", "EventTime")
    return _timed(out)


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams that start here keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def landed(events: DataFrame, ts: str = "ts", batches: int = 4, close_ms: int | None = None) -> tuple[DataFrame, str]:
    """A table as a stream of ``batches`` equal spans of time, one a micro-batch, and the folder its files lie in.

    A span is one file, or as many for each as the smallest span fills, so
    that no task writes all of a large table. The folder is in the shared one.
    ``close_ms`` adds a last file with one row, marked in ``fold_close``, that
    much after the last event: what waits comes due.
    """
    spark, folder = events.sparkSession, f"{shared_folder(events.sparkSession)}/{uuid4().hex}"
    marked = events.withColumn("fold_close", F.lit(False)) if close_ms is not None else events
    span = marked.agg(F.min(micros(ts)).alias("a"), F.max(micros(ts)).alias("b")).first()
    first, last = span.a or 0, span.b or 0
    step = (last - first) // batches + 1
    number = F.floor((micros(ts) - F.lit(first)) / step)
    counts = [n for k, n in marked.groupBy(number.alias("k")).count().collect() if k is not None]
    files = max(1, min(min(counts) // FILE, 64)) if len(counts) == batches else 1
    for k in range(batches):
        own = marked.filter(number == k)
        # dealt in turn, so each file gets rows: some task has as many as there are files
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(f"{folder}/in")
    if close_ms is not None:
        end = F.timestamp_micros(F.lit(last + close_ms * 1000)).cast(marked.schema[ts].dataType)
        blank = [end.alias(c) if c == ts else F.lit(True).alias(c) if c == "fold_close" else F.lit(None).cast(marked.schema[c].dataType).alias(c) for c in marked.columns]
        spark.range(1, numPartitions=1).select(*blank).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), folder


def replayed(events: DataFrame, run: Callable[[DataFrame], DataFrame], ts: str = "ts", batches: int = 4, close_ms: int | None = None) -> DataFrame:
    """What ``run`` makes of a table as a stream (see :func:`landed`), when all of it is taken."""
    stream, folder = landed(events, ts, batches, close_ms)
    with rocks_state(events.sparkSession):
        out = run(stream)
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return events.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")
