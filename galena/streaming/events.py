"""Event streams of a watched library: debounce, spacing, delayed deletes, summaries.

Functions take streaming or static DataFrames with a ``ts`` timestamp and work
alike on both where Spark does; state is kept per path and evicted by
watermark or timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import TimestampNTZType

DEBOUNCE, SPACING_MS, DELAY_MS, FLUSH = "700 milliseconds", 3000, 3000, "500 milliseconds"


def read_events(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Files of a landing directory as a stream, at most ``per_trigger`` a batch (backpressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def debounced(events: DataFrame, gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """(path, first, last, n): bursts of events of a path with no pause as long as ``gap``."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    bursts = marked.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return bursts.select("path", "first", "last", "n")


def summaries(events: DataFrame, flush: str = FLUSH, late: str = "10 seconds") -> DataFrame:
    """(start, added, changed, removed) of each tumbling window with a change."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", flush).alias("w")).agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("add", "added"), ("change", "changed"), ("unlink", "removed"))))
    return out.filter("added + changed + removed > 0").select(F.col("w.start").alias("start"), "added", "changed", "removed")


def spaced_batch(events: DataFrame, keys: list[str], spacing_ms: int = SPACING_MS) -> DataFrame:
    """``events`` with ``accepted``: at least ``spacing_ms`` after the last accepted event of the key.

    A suppressed event does not extend the span. Events of a key are folded in
    time order as they stream by, so no key is held in memory.
    """
    fields = events.schema.names
    schema = events.select("*", F.lit(True).alias("accepted")).schema
    order = [*keys, "ts", *[c for c in fields if c not in keys and c != "ts"]]
    sorted_ = events.repartition(*keys).sortWithinPartitions(*order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for frame in frames:
            at = frame["ts"].to_numpy("datetime64[us]").astype("int64")
            ok = np.zeros(len(at), bool)
            new = np.flatnonzero((frame[keys].ne(frame[keys].shift()) & ~(frame[keys].isna() & frame[keys].shift().isna())).any(axis=1).to_numpy())
            bounds = np.unique(np.r_[0, new, len(at)]) if len(at) else []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = tuple(None if pd.isna(x) else x for x in frame[keys].iloc[a])
                if own != key:
                    key, last = own, None
                k = a if last is None else a + int(np.searchsorted(at[a:b], last + spacing_ms * 1000))
                while k < b:  # from one accepted event straight to the next
                    ok[k], last = True, at[k]
                    k = a + int(np.searchsorted(at[a:b], last + spacing_ms * 1000))
            yield frame.assign(accepted=ok)

    return sorted_.mapInPandas(run, schema)


def spaced_stream(events: DataFrame, spacing_ms: int = SPACING_MS, late: str = "10 seconds") -> DataFrame:
    """Accepted events (path, ts) of a stream: state holds a path's last accepted time (``machines.Spaced`` takes keys of several columns).

    State goes when the watermark is six spacings past that time. Events of a
    batch are taken in time order; one earlier than the last accepted is
    suppressed.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(int(t.value // 1_000_000) for f in frames for t in f["ts"])
        accepted = []
        for t in times:
            if last is None or t - last >= spacing_ms:
                accepted.append(t)
                last = t
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + 6 * spacing_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"path": [key[0]] * len(accepted), "ts": pd.to_datetime(accepted, unit="ms")})

    own = events.withWatermark("ts", late).groupBy("path")
    return own.applyInPandasWithState(fold, "path string, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def settled_deletes(events: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """(path, ts) of unlink events that no add or change of the path follows within ``delay_ms``; tables only.

    ``timed.folded_stream`` with ``machines.Watch`` decides deletes in streams.
    """
    unlink = events.filter(F.col("kind") == "unlink").select("path", "ts").distinct()
    back = events.filter(F.col("kind") != "unlink").select(F.col("path").alias("_path"), F.col("ts").alias("_ts"))
    # times in buckets as long as the delay: what cancels lies in the own bucket or the next
    step = delay_ms * 1000
    u = unlink.withColumn("_b", F.explode(F.array(*(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / step) + k for k in (0, 1)))))
    b = back.withColumn("_b2", F.floor(F.unix_micros(F.col("_ts").cast("timestamp")) / step))
    gap = F.unix_micros(F.col("_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    cancelled = u.join(b, (F.col("path") == F.col("_path")) & (F.col("_b") == F.col("_b2")) & (gap >= 0) & (gap < step)).select("path", "ts").distinct()
    return unlink.join(cancelled, ["path", "ts"], "left_anti")


def stable_files(observations: DataFrame) -> DataFrame:
    """(path, ts) of the first observation whose size and time equal those of the one before; tables only (``machines.Watch`` in streams)."""
    from pyspark.sql import Window

    own = Window.partitionBy("path").orderBy("ts")
    seen = F.struct("size", "mtime")
    same = observations.withColumn("_same", F.lag(seen).over(own) == seen)
    return same.filter("_same").groupBy("path").agg(F.min("ts").alias("ts"))


def batches_of_ids(events: DataFrame, gap: str = "800 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(group, start, end, ids, again): ids of a group's events between pauses, each once, and whether any asked for ``again`` (a full refresh).

    In a table a pause is ``gap`` or longer; Spark's windows of streams go on over one of just ``gap``.
    """
    if events.isStreaming:
        out = events.withWatermark("ts", late).groupBy("group", F.session_window("ts", gap).alias("w")).agg(F.sort_array(F.collect_set("id")).alias("ids"), F.bool_or(F.coalesce("again", F.lit(False))).alias("again"))
        return out.select("group", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ids", "again")
    pause = F.expr(f"INTERVAL {gap}")
    marked = _session_starts(events.filter(F.col("ts").isNotNull()), pause)
    once = marked.groupBy("group", "start", "id").agg(F.max("ts").alias("last"), F.bool_or(F.coalesce("again", F.lit(False))).alias("again"))
    out = once.groupBy("group", "start").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("last").alias("last"), F.bool_or("again").alias("again"))
    return out.select("group", "start", (F.col("last") + pause).alias("end"), "ids", "again")


def _session_starts(events: DataFrame, pause: Column, spans: int = 64) -> DataFrame:
    """``events`` (group, ts, ...) of a table with ``start``: the time of the first event since the last pause.

    A group is cut into about ``spans`` spans of time, each ordered by itself;
    only a row for each span is ordered as a whole.
    """
    from pyspark.sql import Window

    plain = isinstance(events.schema["ts"].dataType, TimestampNTZType)
    second = F.unix_date(F.to_date("ts")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts") if plain else F.floor(F.unix_micros("ts") / 1_000_000)
    low, high = events.agg(F.min(second), F.max(second)).first()
    cut = events.withColumn("_span", F.floor(second / max(1, ((high or 0) - (low or 0)) // spans)))
    ends = cut.groupBy("group", "_span").agg(F.max("ts").alias("_last"))
    of_group, within = Window.partitionBy("group").orderBy("_span"), Window.partitionBy("group", "_span").orderBy("ts")

    def with_span(rows: DataFrame, more: DataFrame) -> DataFrame:
        more = more.withColumnsRenamed({"group": "_group", "_span": "_of"})
        return rows.join(more, F.col("group").eqNullSafe(F.col("_group")) & (F.col("_span") == F.col("_of"))).drop("_group", "_of")

    known = with_span(cut, ends.select("group", "_span", F.lag("_last").over(of_group).alias("_before")))
    gone = F.col("ts") - F.coalesce(F.lag("ts").over(within), "_before")
    fresh = known.withColumn("_new", F.when(gone.isNull() | (gone >= pause), F.col("ts")))
    latest = fresh.groupBy("group", "_span").agg(F.max("_new").alias("_latest"))
    carried = latest.select("group", "_span", F.max("_latest").over(of_group.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    own = F.max("_new").over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # events of one time alike
    return with_span(fresh.withColumn("_own", own), carried).withColumn("start", F.coalesce("_own", "_carried")).drop("_span", "_before", "_new", "_own", "_carried")


def armed_windows(events: DataFrame, keys: list[str], span_ms: int) -> DataFrame:
    """``events`` with ``armed``: the time of the event that began the span it falls in; the first event after a span begins the next. Tables only (``machines.Throttle`` in streams)."""
    from pyspark.sql import Window

    own = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    marked = spaced_batch(events, keys, span_ms)
    return marked.withColumn("armed", F.last(F.when(F.col("accepted"), F.col("ts")), ignorenulls=True).over(own)).drop("accepted")
