"""Streams give the same rows as their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import hotspots as H
from gristmill.operators import locks as L
from gristmill.operators import sched as S
from gristmill.plans import views
from gristmill.streaming import incremental as I
from gristmill.streaming import pairing as P

SF = "/root/testdata/sf0.001"


def _parts(df, path, order, parts):
    """Write ``df`` as ``parts`` files whose names follow ``order``."""
    rows = df.orderBy(order).toPandas()
    size = -(-len(rows) // parts)
    path.mkdir()
    for i in range(parts):
        rows.iloc[i * size:(i + 1) * size].to_parquet(path / f"{i:03d}.parquet")
    return str(path)


def _run(spark, source, schema, build, tmp_path, mode, name):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        build(stream).writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    )
    try:
        query.processAllAvailable()
        assert len(query.recentProgress) >= 3
    finally:
        query.stop()
    return spark.table(name)


def _timed(events):
    return events.withColumn("at", F.timestamp_micros((F.col("ts_ns") / 1000).cast("bigint"))).withWatermark("at", "30 days")


def test_thread_intervals(spark, tmp_path):
    events = views.sched_events(spark, SF).where("event_type <> 'waking'").drop("state")
    source = _parts(events, tmp_path / "sched", "event_index", 4)
    got = _run(spark, source, events.schema, lambda s: P.stream_thread_intervals(_timed(s)), tmp_path, "append", "threads").collect()
    steps = S.transitions(events)
    runs = {(r["tid"], r["switch_in_event_id"], r["switch_out_event_id"], r["duration_ns"]) for r in S.runtime_intervals(steps).collect()}
    lats = {(r["tid"], r["wakeup_event_id"], r["switch_in_event_id"], r["duration_ns"]) for r in S.runnable_latencies(steps).collect()}
    offs = {
        (r["tid"], r["switch_out_event_id"], r["switch_in_event_id"], r["total_ns"], r["incomplete_reason"])
        for r in S.off_cpu_intervals(steps).collect()
    }
    end = {r for r in offs if r[4] == "trace_end_boundary"}
    assert {(r["tid"], r["start_event_id"], r["end_event_id"], r["duration_ns"]) for r in got if r["measure"] == "runtime" and r["reason"] is None} == runs
    assert {(r["tid"], r["start_event_id"], r["end_event_id"], r["duration_ns"]) for r in got if r["measure"] == "runnable"} == lats
    streamed = {(r["tid"], r["start_event_id"], r["end_event_id"], r["duration_ns"], r["reason"]) for r in got if r["measure"] == "off_cpu"}
    split = {(r["end_event_id"], r["blocked_ns"], r["runnable_ns"]) for r in got if r["blocked_ns"] is not None}
    complete = S.off_cpu_intervals(steps).where("blocked_ns is not null")
    assert split == {(r["switch_in_event_id"], r["blocked_ns"], r["runnable_ns"]) for r in complete.collect()} and split
    moved = {}
    for r in got:
        if r["measure"] == "migration":
            moved[r["capture_id"], r["tid"]] = moved.get((r["capture_id"], r["tid"]), 0) + 1
    assert moved == {(r["capture_id"], r["tid"]): r["migration_count"] for r in S.thread_summary(steps).where("migration_count > 0").collect()}
    assert not [r for r in got if r["measure"] == "late"]
    # a stream closes a thread only once the watermark has passed its silence
    assert offs - end <= streamed <= offs


def test_lock_pairs(spark, tmp_path):
    events = views.lock_events(spark, SF).where(~L.is_candidate())
    source = _parts(events, tmp_path / "locks", "event_index", 4)
    got = _run(spark, source, events.schema, lambda s: P.stream_lock_pairs(_timed(s)), tmp_path, "append", "lockpairs").collect()
    steps = L.lock_steps(events)
    waits = {(r["wait_event_id"], r["wait_end_event_id"], r["duration_ns"], r["outcome"]) for r in L.wait_intervals(steps).collect()}
    holds = {(r["acquired_event_id"], r["released_event_id"], r["duration_ns"], None) for r in L.hold_intervals(steps).collect()}
    assert {(r["start_event_id"], r["end_event_id"], r["duration_ns"], r["outcome"]) for r in got if r["measure"] == "wait"} == waits
    assert {(r["start_event_id"], r["end_event_id"], r["duration_ns"], r["outcome"]) for r in got if r["measure"] == "hold"} == holds


def test_hotspots(spark, tmp_path):
    samples = views.samples(spark, SF).select("capture_id", "thread_id", "weight", "frames")
    source = str(tmp_path / "samples")
    samples.repartition(4).write.parquet(source)
    out = _run(spark, source, samples.schema, I.stream_hotspots, tmp_path, "complete", "spots")
    columns = ["capture_id", "symbol", "dso", "self_weight", "inclusive_weight", "sample_count", "stack_occurrence_count", "thread_count"]
    out = I.fold_threads(out)
    assert sorted(out.select(columns).collect()) == sorted(H.hotspots(samples).select(columns).collect())


def test_latest_and_unique(spark, tmp_path):
    events = views.event_rows(spark, SF).select("capture_id", "event_id", "ts_ns", "value")
    doubled = events.unionByName(events.where("event_id % 5 = 0"))
    source = _parts(doubled, tmp_path / "events", "ts_ns", 4)
    last = _run(spark, source, events.schema, I.latest_snapshots, tmp_path, "complete", "latest")
    want = {r[0]: r[1] for r in events.groupBy("capture_id").agg(F.max("ts_ns")).collect()}
    assert {r["capture_id"]: r["ts_ns"] for r in last.collect()} == want
    timed = lambda s: I.unique_events(s.withColumn("at", F.timestamp_micros((F.col("ts_ns") / 1000).cast("bigint"))), "at", "1 hour")
    unique = _run(spark, source, events.schema, timed, tmp_path, "append", "uniq")
    assert unique.count() == events.count()
