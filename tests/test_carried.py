"""Streams of shuffled rows give what the batch operators give over the rows that came in time."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import locks as L
from gristmill.operators import sched as S
from gristmill.streaming import carried as C

SCHED = "capture_id int, tid long, event_index long, event_id long, ts_ns long, cpu long, event_type string, state string"
LOCK = "capture_id int, tid long, lock_id string, event_index long, event_id long, ts_ns long, event_type string, path_no int, owner_evidence string"


def sched_rows(n, seed=1):
    """One thread has a third of all rows."""
    rng = random.Random(seed)
    kinds = ["switch_in", "switch_out", "wakeup", "migrate", "waking"]
    return [(1, rng.choice([1, 1, 2, 3, 4]), i, 1000 + i, 10 * i, rng.randrange(3), rng.choice(kinds), rng.choice("SRD")) for i in range(n)]


def lock_rows(n, seed=2):
    rng = random.Random(seed)
    kinds = ["lock_wait", "acquired", "released", "timed_out", "futex_wait"]
    return [(1, rng.choice([1, 1, 2]), rng.choice("ab"), i, 1000 + i, 10 * i, rng.choice(kinds), i % 3, "target") for i in range(n)]


def plain(df, columns=None):
    return sorted((str(tuple(r)) for r in df.select(*(columns or df.columns)).collect()))


def deal(rows, parts, reach, seed=3):
    """Rows in ``parts`` batches, each up to ``reach`` places away from its own."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[-4] / 10 + rng.random() * reach)
    size = -(-len(order) // parts)
    return [order[i * size : (i + 1) * size] for i in range(parts)]


def check(spark, folder, kind, rows, schema, batches, delay, operators):
    frame = spark.createDataFrame(rows, schema)
    stream = C.CarriedPairing(spark, folder, kind, frame.schema, delay_ns=delay, silence_ns=1 << 60)
    marks, seen, late = [], None, set()
    for i, part in enumerate(batches):
        before = None if seen is None else seen - delay
        late |= {r for r in part if before is not None and r[schema.split(", ").index("ts_ns long")] <= before}
        stream.step(spark.createDataFrame(part, schema).repartition(3), i)
        at = schema.split(", ").index("ts_ns long")
        seen = max([x for x in (seen, *[r[at] for r in part]) if x is not None])
        marks.append(seen)
    stream.finish(len(batches))
    assert {tuple(r) for r in stream.result("late").select(*frame.columns).collect()} == late
    in_time = [r for r in rows if r not in late]
    steps = kind.steps(spark.createDataFrame(in_time, schema))
    for name, operator in operators.items():
        want = operator(steps)
        assert plain(stream.result(name), want.columns) == plain(want), name
    return late


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    rows = sched_rows(600, seed=4)
    late = check(spark, str(tmp_path / "a"), C.THREADS, rows, SCHED, deal(rows, 3, 200), 10 * 20, C.THREADS.results)
    assert 5 < len(late) < 300


def test_locks_in_shuffled_batches(spark, tmp_path):
    rows = lock_rows(800)
    late = check(spark, str(tmp_path / "a"), C.LOCKS, rows, LOCK, deal(rows, 3, 50), 10 * 60, C.LOCKS.results)
    assert not late


def test_results_nobody_wants_are_not_written(spark, tmp_path):
    rows = sched_rows(300, seed=9)
    found = {}
    for folder, wanted in (("all", None), ("one", ["off_cpu"]), ("none", [])):
        frame = spark.createDataFrame(rows, SCHED)
        stream = C.CarriedPairing(spark, str(tmp_path / folder), C.THREADS, frame.schema, delay_ns=200, silence_ns=1 << 60, wanted=wanted)
        for i, part in enumerate(deal(rows, 2, 60)):
            stream.step(spark.createDataFrame(part, SCHED), i)
        stream.finish(2)
        found[folder] = stream
    written = lambda folder: {p.name for p in (tmp_path / folder).iterdir()} & set(C.THREADS.results)
    assert written("all") == set(C.THREADS.results) and written("one") == {"off_cpu"} and not written("none")
    assert plain(found["one"].result("off_cpu")) == plain(found["all"].result("off_cpu"))
    assert plain(found["none"].result("late")) == plain(found["all"].result("late"))


def test_a_batch_may_run_again(spark, tmp_path):
    rows = sched_rows(400, seed=6)
    parts = deal(rows, 2, 10)
    frame = spark.createDataFrame(rows, SCHED)
    stream = C.CarriedPairing(spark, str(tmp_path / "a"), C.THREADS, frame.schema, delay_ns=200, silence_ns=1 << 60)
    for i, part in enumerate(parts):
        batch = spark.createDataFrame(part, SCHED)
        stream.step(batch, i)
        stream.step(batch, i)
    stream = C.CarriedPairing(spark, str(tmp_path / "a"), C.THREADS, frame.schema, delay_ns=200, silence_ns=1 << 60)  # a new driver
    stream.finish(len(parts))
    steps = S.transitions(frame)
    assert plain(stream.result("runs")) and plain(stream.result("runs"), S.runtime_intervals(steps).columns) == plain(S.runtime_intervals(steps))
    assert plain(stream.result("off_cpu"), S.off_cpu_intervals(steps).columns) == plain(S.off_cpu_intervals(steps))


def test_silent_keys_are_ended(spark, tmp_path):
    rows = [(1, 1, 0, 1, 0, 0, "switch_in", "S"), (1, 2, 1, 2, 10, 0, "switch_out", "S"), (1, 1, 2, 3, 1000, 0, "switch_out", "S"), (1, 1, 3, 4, 5000, 0, "switch_in", "S")]
    stream = C.CarriedPairing(spark, str(tmp_path / "a"), C.THREADS, spark.createDataFrame(rows, SCHED).schema, delay_ns=0, silence_ns=2000)
    for i, r in enumerate(rows):
        stream.step(spark.createDataFrame([r], SCHED), i)
    offs = {(r.tid, r.switch_out_event_id, r.switch_in_event_id, r.incomplete_reason) for r in stream.result("off_cpu").collect()}
    # thread 1 has an interval; thread 2 was silent for longer than 2000 and is closed
    assert (2, 2, None, "trace_end_boundary") in offs and (1, 3, 4, "missing_wakeup") in offs
    assert spark.read.parquet(stream._path("carry", 3)).select("tid").distinct().count() == 1


@pytest.mark.parametrize("kind, schema", [(C.THREADS, SCHED), (C.LOCKS, LOCK)])
def test_nothing_comes(spark, tmp_path, kind, schema):
    empty = spark.createDataFrame([], schema)
    stream = C.CarriedPairing(spark, str(tmp_path / "a"), kind, empty.schema, delay_ns=0)
    stream.step(empty, 0)
    stream.step(empty, 1)
    stream.finish(2)
    assert all(stream.result(n).isEmpty() for n in [*kind.results, "late"])


def test_as_function_of_a_stream(spark, tmp_path):
    rows = lock_rows(300, seed=9)
    for i, part in enumerate(deal(rows, 3, 5)):
        spark.createDataFrame(part, LOCK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    frame = spark.createDataFrame(rows, LOCK)
    stream = C.CarriedPairing(spark, str(tmp_path / "out"), C.LOCKS, frame.schema, delay_ns=400, silence_ns=1 << 60)
    source = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = source.writeStream.foreachBatch(stream.step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    last = max(int(r.batch) for r in spark.read.parquet(f"{stream.folder}/late").select("batch").distinct().collect()) if not stream.result("late").isEmpty() else run.lastProgress["batchId"]
    stream.finish(max(last, run.lastProgress["batchId"]) + 1)
    late = {r.event_id for r in stream.result("late").collect()}
    steps = L.lock_steps(frame.where(~F.col("event_id").isin(list(late) or [-1])))
    assert plain(stream.result("waits"), L.wait_intervals(steps).columns) == plain(L.wait_intervals(steps))
