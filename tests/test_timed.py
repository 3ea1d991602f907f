"""Keyed machines: known cases, and streams against tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from galena.streaming import machines, timed
from galena.streaming.machines import MS

SCHEMA = "root string, path string, at long, kind string, size long, mtime long, id long"


def fold(machine, events):
    """(ms, *output) of events (ms, *fields) of one key, state through JSON at every step."""
    state, out = machine.start(), []
    for at, *event in events:
        out += machines.advance(machine, state, iter([(at * MS, tuple(event))]), None)
        state = json.loads(json.dumps(state))
    out += machines.advance(machine, state, iter(()), 1 << 62)
    assert state == machine.start() or isinstance(machine, machines.IdBatches)
    return [(t // MS, *r) for t, *r in out]


def test_spaced():
    got = fold(machines.Spaced(3000), [(0, 1), (2999, 2), (3000, 3), (5000, 4), (5999, 5), (6000, 6), (99_999, 7)])
    assert [(i, ok) for _, ok, i in got] == [(1, True), (2, False), (3, True), (4, False), (5, False), (6, True), (7, True)]


@pytest.mark.parametrize("events, want", [
    ([(0, "add", 5, 1)], [(950, "synced")]),
    ([(0, "add", 5, 1), (600, "change", 6, 2)], [(1550, "synced")]),  # the wait begins anew
    ([(0, "add", 5, 1), (800, "change", 6, 2)], [(1200, "synced"), (1750, "synced")]),  # a change between looks, then its own wait
    ([(0, "add", 0, 1)], [(2700, "skipped")]),  # empty at all eight looks
    ([(0, "add", 5, 1), (750, "unlink", None, None)], [(950, "skipped"), (3750, "removed")]),
    ([(0, "unlink", None, None), (2999, "add", 5, 1)], [(3250, "synced")]),  # back in time: looked at at once, in place of its wait
    ([(0, "unlink", None, None), (2000, "unlink", None, None)], [(5000, "removed")]),  # the delay begins anew
    ([(0, "unlink", None, None), (3000, "add", 5, 1)], [(3000, "removed"), (3950, "synced")]),  # an alarm comes before an event of its time
])
def test_watch(events, want):
    assert fold(machines.Watch(), events) == want


def test_throttle():
    got = fold(machines.Throttle(500), [(0, "added"), (499, "skipped"), (500, "updated"), (700, "removed"), (2000, "skipped")])
    assert got == [(500, 1, 0, 0, 2), (1000, 0, 1, 1, 2)]  # a span without a change is not told


def test_scan_gate():
    gate = machines.ScanGate()
    assert fold(gate, [(0, "startup"), (500, "focus"), (30_000, "focus"), (31_000, "manual"), (31_200, "focus"), (91_300, "focus"), (91_400, "manual")]) == [(800, "focus"), (91_700, "manual")]
    assert fold(gate, [(0, "manual"), (60_299, "focus"), (60_300, "focus")]) == [(300, "manual"), (60_600, "focus")]


def test_single_flight():
    flight = machines.SingleFlight(lease_ms=1000)
    assert fold(flight, [(0, "wake"), (10, "wake"), (20, "wake"), (50, "failed"), (60, "done"), (70, "done"), (80, "wake")]) == [(0, "start"), (50, "start"), (80, "start"), (1080, "lost")]
    assert fold(flight, [(0, "wake"), (10, "wake"), (1000, "wake")]) == [(0, "start"), (1000, "lost"), (1000, "start"), (2000, "lost"), (2000, "start"), (3000, "lost")]


def test_id_batches():
    got = fold(machines.IdBatches(800), [(0, "x", 1), (100, "x", 2), (200, "x", 1), (1500, "failed", 9), (5000, "x", 3)])
    assert got == [(1000, 1), (1000, 2), (5800, 9), (5800, 3)]


MACHINES = {
    "spaced": (machines.Spaced(3000), ["root", "path"], None), "watch": (machines.Watch(), ["path"], None), "throttle": (machines.Throttle(700), ["root"], {"add": "added", "change": "updated", "unlink": "removed"}),
    "gate": (machines.ScanGate(5000), ["root"], {"add": "startup", "change": "focus", "unlink": "manual"}), "flight": (machines.SingleFlight(4000), ["root", "path"], {"add": "wake", "change": "wake", "unlink": "done"}), "ids": (machines.IdBatches(900), ["path"], None),
}


@pytest.fixture(scope="module")
def watched(spark):
    rng = random.Random(4)
    rows, at = [], 1_700_000_000_000_000
    for k in range(400):
        at += int(rng.expovariate(1 / 400_000))
        path = rng.choice(["a", "a", "b", "c", None])
        rows.append((rng.choice(["r", "q"]), path, at, rng.choice(["add", "change", "unlink"]), rng.choice([0, 5, 5, 7, None]), rng.choice([1, 2]), k % 40))
    rows += [("r", "a", rows[50][2], "add", 3, 1, 41), ("r", "a", None, "add", 3, 1, 42)]  # one time twice; no time
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("at")).drop("at").repartition(2).cache()


def text(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_streams_agree_with_tables(name, spark, watched):
    machine, keys, kinds = MACHINES[name]
    field = machine.fields[0]
    rows = watched
    if kinds:
        rows = rows.withColumn(field, F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("kind")))
    want = text(timed.folded(rows, keys, machine, order=("id", "kind")))
    got = text(timed.replayed(rows, lambda s: timed.folded_stream(s, keys, machine, order=("id", "kind"), late="3 seconds"), batches=3, close_ms=600_000))
    assert got == want and len(want) > 5


def test_large_spans_are_several_files_and_state_is_packed(spark, watched, monkeypatch):
    """The files of a span are one micro-batch; the events that wait for a key are few rows of its state."""
    monkeypatch.setattr(timed, "FILE", 20, raising=False)
    machine, kinds = machines.Throttle(700), {"add": "added", "change": "updated", "unlink": "removed"}
    rows = watched.replace(kinds, subset="kind")
    want = text(timed.folded(rows, ["root"], machine, order=("id", "kind")))
    stream, folder = timed.landed(rows, batches=3, close_ms=7_200_000)
    files = spark.read.parquet(f"{folder}/in").select(F.input_file_name()).distinct().count()
    assert files > 4 and files % 3 == 1
    with timed.rocks_state(spark):
        out = timed.folded_stream(stream, ["root"], machine, order=("id", "kind"), late="1 hour")  # all waits until the close
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("batchId", 2).load(f"{folder}/state")
    assert 2 <= waiting.count() <= 6  # of two keys, a row for each batch
    assert text(spark.read.schema(out.schema).parquet(f"{folder}/out")) == want


def test_empty(spark, watched):
    for machine, keys, _ in MACHINES.values():
        rows = watched.withColumn("reason", F.col("kind")).limit(0)
        assert timed.folded(rows, keys, machine).count() == 0


def test_restart_and_empty_state(spark, watched, tmp_path):
    """A stream that stops half way goes on from its checkpoint, and keeps nothing once the watermark has passed."""
    machine, rows = machines.Watch(), watched.withColumn("fold_close", F.lit(False))
    want = text(timed.folded(watched, ["path"], machine, order=("id", "kind")))
    half = rows.agg(F.percentile_approx("ts", 0.5)).first()[0]
    end = spark.sql("SELECT timestamp'2030-01-01' AS ts, true AS fold_close")
    parts = [rows.filter(F.col("ts") < half), rows.filter(F.col("ts") >= half), rows.limit(0).unionByName(end, allowMissingColumns=True)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with timed.rocks_state(spark):
            out = timed.folded_stream(stream, ["path"], machine, order=("id", "kind"), late="3 seconds")
            query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
            query.awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "machine").load(f"{tmp_path}/state")
        kept = state.count()
        assert kept > 0 or part is parts[-1]
    assert kept == 0
    assert text(spark.read.schema(out.schema).parquet(f"{tmp_path}/out")) == want


def test_requeue_runs_a_batch_again(spark, tmp_path):
    """A batch that runs twice leaves the record as if it had run once."""
    from galena.streaming.requeue import Requeue

    sink = Requeue(str(tmp_path), lambda todo: todo.filter((F.col("id") % 2 == 0) & (F.col("tries") < 2)))
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    for batch, own in [(0, (1, 2, 2, None)), (1, (3,)), (1, (3,)), (2, (4,))]:
        sink(ids(*own), batch)
    assert sorted(tuple(r) for r in sink.done(spark).collect()) == [(1, 0, 0), (2, 2, 2), (3, 0, 1)]
    assert [tuple(r) for r in sink.left(spark, 2).collect()] == [(4, 1)]
