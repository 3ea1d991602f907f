"""Queries over the events of a watched library, as tables and as streams, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.queries import query
from galena.sources.library import view
from galena.streaming import machines, timed
from galena.streaming.requeue import Requeue

HOUR = 3_600_000
WATCH = machines.Watch(settle_ms=6 * HOUR, delay_ms=24 * HOUR, probe_ms=2 * HOUR)

WATCH_SQL = """
    WITH e AS (SELECT path, kind, ts, event_id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE size END AS size, event_id % 3 AS mtime FROM fs_events),
    u AS (SELECT path, ts + INTERVAL 24 HOUR AS t, lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS nxt FROM e WHERE kind = 'unlink'),
    d AS (SELECT path, t FROM u WHERE nxt IS NULL OR nxt >= t),
    x AS (SELECT d.path, d.t, e.kind AS seen FROM d ASOF JOIN e ON d.path = e.path AND d.t > e.ts),
    a AS (SELECT path, ts AS t, ts + INTERVAL 6 HOUR AS f FROM e WHERE kind <> 'unlink' UNION ALL SELECT path, t, t FROM x WHERE seen <> 'unlink'),
    s AS (SELECT path, f FROM (SELECT *, lead(t) OVER (PARTITION BY path ORDER BY t, f) AS nxt FROM a) WHERE nxt IS NULL OR nxt >= f),
    p AS (SELECT path, f, k, f + k * INTERVAL 2 HOUR AS t FROM s, range(0, 9) AS r(k)),
    o AS (SELECT p.*, e.kind, e.size, e.mtime FROM p ASOF JOIN e ON p.path = e.path AND p.t > e.ts),
    w AS (SELECT *, last_value(CASE WHEN kind <> 'unlink' AND size > 0 THEN size * 10 + mtime END IGNORE NULLS) OVER (PARTITION BY path, f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM o),
    z AS (SELECT *, CASE WHEN k = 8 OR kind = 'unlink' THEN 'skipped' WHEN size > 0 AND size * 10 + mtime = prev THEN 'synced' END AS outcome FROM w)
    SELECT path, min(t) AS at, arg_min(outcome, k) AS outcome FROM z WHERE outcome IS NOT NULL GROUP BY path, f
    UNION ALL SELECT path, t, 'removed' FROM x WHERE seen = 'unlink'"""


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fs_events").withColumns({"mtime": F.col("event_id") % 3, "size": F.when(F.col("event_id") % 6 == 0, F.lit(0)).otherwise(F.col("size"))})


def _plain_time(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(WATCH_SQL, "fs_events")
def watched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of paths: settled after two equal looks, skipped, or removed after a delay."""
    return _plain_time(timed.folded(_watched(spark, sf_dir), ["path"], WATCH, order=("event_id",)))


@query(WATCH_SQL, "fs_events")
def watched_files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream in several micro-batches, with keyed state and timers."""
    run = lambda s: timed.folded_stream(s, ["path"], WATCH, order=("event_id",), late="1 hour")
    return _plain_time(timed.replayed(_watched(spark, sf_dir), run, close_ms=240 * HOUR))


SHELVES = "SELECT substr(path, 5, 1) AS shelf, event_id % 3 AS part, ts, event_id, CASE kind WHEN 'add' THEN 'added' WHEN 'unlink' THEN 'removed' WHEN 'change' THEN CASE WHEN event_id % 2 = 0 THEN 'updated' ELSE 'skipped' END END AS kind FROM fs_events"

THROTTLE_SQL = f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY shelf, part ORDER BY ts, event_id) AS n FROM ({SHELVES})),
    f AS (SELECT shelf, part, n, kind, ts AS armed FROM e WHERE n = 1
          UNION ALL SELECT e.shelf, e.part, e.n, e.kind, CASE WHEN e.ts - f.armed >= INTERVAL 5 HOUR THEN e.ts ELSE f.armed END FROM f JOIN e ON e.shelf = f.shelf AND e.part = f.part AND e.n = f.n + 1)
    SELECT shelf, part, armed + INTERVAL 5 HOUR AS at, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'updated') AS updated, count(*) FILTER (kind = 'removed') AS removed, count(*) AS scanned
    FROM f GROUP BY shelf, part, armed HAVING count(*) FILTER (kind <> 'skipped') > 0"""


def _shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SHELVES.replace("FROM fs_events", "FROM {events}"), events=view(spark, sf_dir, "fs_events"))


@query(THROTTLE_SQL, "fs_events")
def throttled_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a shelf's part, told five hours after the first of them."""
    return _plain_time(timed.folded(_shelves(spark, sf_dir), ["shelf", "part"], machines.Throttle(5 * HOUR), order=("event_id",)))


@query(THROTTLE_SQL, "fs_events")
def throttled_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, keyed by two columns."""
    run = lambda s: timed.folded_stream(s, ["shelf", "part"], machines.Throttle(5 * HOUR), order=("event_id",), late="1 hour")
    return _plain_time(timed.replayed(_shelves(spark, sf_dir), run, close_ms=240 * HOUR))


@query(
    """
    WITH RECURSIVE r AS (SELECT path, ts, event_id, CASE kind WHEN 'add' THEN 'startup' WHEN 'change' THEN 'focus' ELSE 'manual' END AS reason FROM fs_events),
    e AS (SELECT *, ts + CASE reason WHEN 'startup' THEN INTERVAL 9 HOUR ELSE INTERVAL 4 HOUR END AS wanted, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY path) AS total FROM r),
    f AS (SELECT path, n, total, CAST(NULL AS TIMESTAMP) AS last, wanted AS due, reason, CAST(NULL AS TIMESTAMP) AS fired, CAST(NULL AS VARCHAR) AS why FROM e WHERE n = 1
          UNION ALL SELECT path, n, total, last, CASE WHEN refused THEN NULL ELSE wanted END, reason, fired, why FROM (
              SELECT *, coalesce(reason = 'focus' AND ts - last < INTERVAL 36 HOUR, FALSE) AS refused FROM (
                  SELECT e.path, e.n, e.total, e.ts, e.reason, e.wanted, CASE WHEN f.due <= e.ts THEN f.due ELSE f.last END AS last, CASE WHEN f.due <= e.ts THEN f.due END AS fired, CASE WHEN f.due <= e.ts THEN f.reason END AS why
                  FROM f JOIN e ON e.path = f.path AND e.n = f.n + 1)))
    SELECT path, fired AS at, why AS reason FROM f WHERE fired IS NOT NULL UNION ALL SELECT path, due, reason FROM f WHERE n = total AND due IS NOT NULL""",
    "fs_events",
)
def scan_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that requests start, with a least span before a focus starts another."""
    reason = F.when(F.col("kind") == "add", "startup").when(F.col("kind") == "change", "focus").otherwise("manual")
    gate = machines.ScanGate(36 * HOUR, 4 * HOUR, 9 * HOUR)
    return _plain_time(timed.folded(view(spark, sf_dir, "fs_events").withColumn("reason", reason), ["path"], gate, order=("event_id",)))


FLIGHT_SQL = """
    WITH RECURSIVE r AS (SELECT path, ts, event_id, kind <> 'unlink' AS wake FROM fs_events),
    e AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS n FROM r
          UNION ALL SELECT path, TIMESTAMP '2100-01-01', 0, NULL, count(*) + 1 FROM r GROUP BY path),
    f AS (SELECT path, n, ts, wake, CASE WHEN wake THEN ts + INTERVAL 48 HOUR END AS ends, FALSE AS dirty, CAST(NULL AS TIMESTAMP) AS lost, CAST(NULL AS TIMESTAMP) AS again, CAST(NULL AS TIMESTAMP) AS lost_again, CASE WHEN wake THEN ts END AS started FROM e WHERE n = 1
          UNION ALL SELECT path, n, ts, wake,
              CASE WHEN wake IS NULL THEN NULL WHEN wake THEN coalesce(ends, ts + INTERVAL 48 HOUR) WHEN ends IS NOT NULL AND dirty THEN ts + INTERVAL 48 HOUR END,
              coalesce(wake AND (dirty OR ends IS NOT NULL), FALSE), lost, again, lost_again,
              CASE WHEN wake AND ends IS NULL OR NOT wake AND ends IS NOT NULL AND dirty THEN ts END
          FROM (SELECT path, n, ts, wake, lost, again, CASE WHEN again + INTERVAL 48 HOUR <= ts THEN again + INTERVAL 48 HOUR END AS lost_again,
                       CASE WHEN lost IS NULL THEN ends WHEN again IS NULL OR again + INTERVAL 48 HOUR <= ts THEN NULL ELSE again + INTERVAL 48 HOUR END AS ends, CASE WHEN lost IS NULL THEN dirty ELSE FALSE END AS dirty
                FROM (SELECT e.path, e.n, e.ts, e.wake, f.ends, f.dirty, CASE WHEN f.ends <= e.ts THEN f.ends END AS lost, CASE WHEN f.ends <= e.ts AND f.dirty THEN f.ends END AS again FROM f JOIN e ON e.path = f.path AND e.n = f.n + 1)))
    SELECT path, "at", move FROM (
        SELECT path, lost AS "at", 'lost' AS move FROM f UNION ALL SELECT path, again, 'start' FROM f UNION ALL SELECT path, lost_again, 'lost' FROM f UNION ALL SELECT path, started, 'start' FROM f) WHERE "at" IS NOT NULL"""


def _wakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fs_events").withColumn("kind", F.when(F.col("kind") != "unlink", "wake").when(F.col("event_id") % 2 == 0, "done").otherwise("failed"))


@query(FLIGHT_SQL, "fs_events")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a path, one at a time; some fail, some are lost."""
    return _plain_time(timed.folded(_wakes(spark, sf_dir), ["path"], machines.SingleFlight(48 * HOUR), order=("event_id",)))


@query(FLIGHT_SQL, "fs_events")
def single_flight_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda s: timed.folded_stream(s, ["path"], machines.SingleFlight(48 * HOUR), order=("event_id",), late="1 hour")
    return _plain_time(timed.replayed(_wakes(spark, sf_dir), run, close_ms=240 * HOUR))


@query(
    """
    WITH s AS (SELECT path, ts, lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS nxt FROM fs_events WHERE kind <> 'unlink'),
    f AS (SELECT path, ts + INTERVAL 12 HOUR AS at FROM s WHERE nxt IS NULL OR nxt >= ts + INTERVAL 12 HOUR)
    SELECT DISTINCT e.path, f.at, e.event_id % 5 AS id FROM fs_events e ASOF JOIN f ON e.path = f.path AND e.ts < f.at""",
    "fs_events",
)
def id_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids gathered between pauses; failed ones come back and wait for the next."""
    e = view(spark, sf_dir, "fs_events").select("path", "ts", "event_id", F.when(F.col("kind") == "unlink", "failed").otherwise("new").alias("kind"), (F.col("event_id") % 5).alias("id"))
    return _plain_time(timed.folded(e, ["path"], machines.IdBatches(12 * HOUR), order=("event_id",)))


@query(
    """
    WITH b AS (SELECT event_id AS id, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / ((SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) // 4 + 1 FROM events))) AS BIGINT) AS b,
                      CASE WHEN event_id % 15 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS fails FROM events)
    SELECT id, CAST(fails AS INTEGER) AS tries, b + fails AS batch, 'done' AS state FROM b WHERE b + fails <= 3
    UNION ALL SELECT id, CAST(4 - b AS INTEGER), NULL, 'left' FROM b WHERE b + fails > 3"""
)
def requeued_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's ids worked on by batches; those that fail, once or twice, go with the next."""
    stream, folder = timed.landed(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "ts"))
    fails = F.when(F.col("id") % 15 == 0, 2).when(F.col("id") % 3 == 0, 1).otherwise(0)
    sink = Requeue(f"{folder}/ids", lambda todo: todo.filter(F.col("tries") < fails))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    left = sink.left(spark, 3).select("id", "tries", F.lit(None).cast("long").alias("batch"), F.lit("left").alias("state"))
    return sink.done(spark).select("id", "tries", "batch", F.lit("done").alias("state")).unionByName(left)
