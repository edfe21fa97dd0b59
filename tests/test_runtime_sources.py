"""Runtime-lock sources against hand-written expectations."""

from __future__ import annotations

import json

from gristmill.operators import runtime_locks as R
from gristmill.sources import adapters as A
from gristmill.sources import runtime_ndjson as N

PID, WORKER, PEER = 700, 702, 705
VERSION = "1.1"


def _thread(tid):
    return {"kind": "os_thread", "target_pid": PID, "target_tid": tid}


def _header(**more):
    return {
        "schema_version": VERSION, "record_type": "runtime_lock_header", "runtime": "python", "runtime_version": "9",
        "adapter_id": "made-up", "adapter_version": "3", "backend_id": "none", "backend_version": "2",
        "target": {"target_pid": PID, "target_uid": 9, "target_start_time_ticks": 61, "observed_target_tids": [PID, WORKER, PEER], "target_kind": "host"},
        "clock": {"clock": "monotonic", "unit": "nanoseconds", "epoch_correlation_available": False},
        "measurement_semantics": "exact", "visible_lock_kinds": ["mutex", "rwlock"], "fast_path_visibility": "partial",
        "owner_is_source_observed": True, "hold_time_is_source_observed": True, "declared_event_count": 8,
        "declared_lost_event_count": 0, "declared_truncated": False, **more,
    }


STACK = {
    "schema_version": VERSION, "record_type": "runtime_lock_stack", "source_stack_id": "deep",
    "frames": [{"symbol": f"level{i}", "module": f"/opt/own/mod{i}.so", "source_file": f"/src/own/l{i}.py", "source_line": 3 + i} for i in range(3)],
}


def _event(sid, kind, ts, tid=WORKER, **more):
    return {
        "schema_version": VERSION, "record_type": "runtime_lock_event", "source_event_id": sid, "event_kind": kind,
        "timestamp_ns": ts, "execution_context": _thread(tid), "source_lock_id": "gate", "lock_kind": "rwlock",
        "source_stack_id": "deep", **more,
    }


def _visit(tag, start, waited, held, **more):
    """Wait, acquire and release of one visit."""
    got = start + waited
    return [
        _event(f"{tag}.wait", "wait_begin", start, **more),
        _event(f"{tag}.end", "wait_end", got, wait_begin_source_event_id=f"{tag}.wait", duration_ns=waited, outcome="acquired"),
        _event(f"{tag}.take", "acquire", got, wait_end_source_event_id=f"{tag}.end"),
        _event(f"{tag}.drop", "release", got + held, acquire_source_event_id=f"{tag}.take", hold_duration_ns=held),
    ]


VISITS = {"one": (7_000, 33, 410), "two": (9_000, 8, 77)}
GOOD = [e for tag, times in VISITS.items() for e in _visit(tag, *times, owner_execution_context=_thread(PEER))]


def _lines(spark, records):
    rows = [("c", i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(records, 1)]
    return spark.createDataFrame(rows, "capture_id string, line_no long, line string")


def _accept(spark, records):
    stream = N.parse_stream(_lines(spark, records))
    return stream, N.accept_events(stream.events, stream.headers, stream.stacks)


def test_valid_stream(spark):
    stream, judged = _accept(spark, [_header(), STACK, *GOOD])
    c = N.import_counters(judged, stream.stacks, stream.headers).collect()[0]
    assert (c["input_events"], c["emitted_events"], c["emitted_stacks"], c["quality_status"]) == (8, 8, 1, "complete")
    assert c["count_matches_header"] and c["owner_observed_events"] == len(VISITS)
    frames = stream.stacks.collect()[0]["frames"]
    assert [(f["module"], f["source_file"], f["symbol"]) for f in frames] == [(f"mod{i}.so", f"l{i}.py", f"level{i}") for i in range(3)]
    result = R.replay(N.normalized_events(judged))
    assert sorted((w["duration_ns"], w["outcome"], w["owner_observed"]) for w in result.waits.collect()) == sorted(
        (waited, "acquired", True) for _, waited, _ in VISITS.values()
    )
    assert sorted(h["duration_ns"] for h in result.holds.collect()) == sorted(held for *_, held in VISITS.values())
    assert result.issues.count() == 0
    gates = N.conclusions(N.import_counters(judged, stream.stacks, stream.headers), judged, stream.headers).collect()[0]
    assert "observed_runtime_hold_distribution" in gates["allowed_conclusions"]
    assert set(gates["forbidden_conclusions"]) == {
        "performance_root_cause", "verified_improvement", "cross_artifact_lock_identity", "system_wide_or_cross_target_behavior",
    }


def test_rejected_rows_reserve_nothing(spark):
    first = GOOD[:4]
    judged_as = [
        (_event("far", "wait_begin", 60_000, tid=1), "OUTSIDE_TARGET_CONTEXT"),  # moves no clock
        ({**_event("one.wait", "wait_begin", 50_000), "lock_kind": "semaphore"}, "UNDECLARED_LOCK_KIND"),  # keeps no id
        (first[0], None),
        (_event("one.wait", "wait_begin", 7_001), "DUPLICATE_EVENT_ID"),
        (_event("slow", "wait_begin", 6_999), "OUT_OF_ORDER_EVENT"),
        (_event("slow.end", "wait_end", 7_010, wait_begin_source_event_id="slow", duration_ns=11, outcome="acquired"), "INVALID_EVENT_PAIR"),
        *[(e, None) for e in first[1:]],
        ("{", "INVALID_JSON"),
        ({"record_type": "something_else"}, "UNSUPPORTED_RECORD"),
        (_event("odd", "yield", 8_000), "UNSUPPORTED_EVENT"),
        (_event("wide", "wait_begin", 8_001, duration_ns=4), "INVALID_EVENT"),  # a field of another kind
        (_event("lost", "wait_begin", 8_002, source_stack_id="nowhere"), "UNKNOWN_STACK_ID"),
        (_event("bare", "release", 8_003, acquire_source_event_id="one.take"), "INVALID_EVENT_PAIR"),
    ]
    stream, judged = _accept(spark, [_header(), STACK, *[record for record, _ in judged_as]])
    got = [(r["line_no"], r["reason"]) for r in judged.orderBy("line_no").collect()]
    assert got == [(line, reason) for line, (_, reason) in enumerate(judged_as, 3)]
    c = N.import_counters(judged, stream.stacks, stream.headers).collect()[0]
    assert (c["duplicate"], c["out_of_order"], c["unsupported"], c["filtered"]) == (1, 1, 3, 1)
    assert c["quality_status"] == "partial" and c["open_waits"] == 0


def test_null_keys_stay_out_of_the_joins(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(
        F.lit("c").alias("capture_id"), F.col("id").alias("event_index"), F.col("id").cast("string").alias("event_id"),
        (F.col("id") * 10).alias("ts_ns"), F.lit("t").alias("context"), F.when(F.col("id") % 2 == 0, "wait_begin").otherwise("wait_end").alias("event_kind"),
        F.lit("exact").alias("semantics"), F.lit("mutex").alias("lock_kind"), F.lit("gate").alias("lock_id"),
        F.when(F.col("id") % 20 == 1, (F.col("id") - 1).cast("string")).alias("wait_begin_event_id"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = R._with_references(rows)
        sizes = met.groupBy(F.spark_partition_id()).count().collect()
        assert met.count() == 4000 and max(r["count"] for r in sizes) < 1000
        assert met.where("ref is not null").count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def _probe(seq, sid, kind, ts, lock_kind="recursive_mutex", **more):
    record = {
        "record_type": "probe_event", "sequence": seq, "source_event_id": sid, "event_kind": kind, "timestamp_ns": ts,
        "pid": PID, "tid": PEER, "raw_lock_token": "7e", "lock_kind": lock_kind, "related_source_event_id": None,
        "duration_ns": None, "hold_duration_ns": None, "result": "unknown", "stack_id": "deep",
    }
    return record | more


def _nested(depth):
    """``depth`` acquires of one lock at times 10, 20, …, released from the innermost out."""
    take = [_probe(i, f"in{i}", "acquire", 10 * i, result="acquired") for i in range(1, depth + 1)]
    drop = []
    for n, i in enumerate(range(depth, 0, -1), 1):
        at = 10 * depth + 7 * n
        drop.append(_probe(depth + n, f"out{i}", "release", at, related_source_event_id=f"in{i}", hold_duration_ns=at - 10 * i, result="released"))
    return take + drop


def test_native_probe(spark):
    records = _nested(3)
    rows = A.native_events(_lines(spark, records[::-1])).orderBy("line_no").collect()
    assert [r["source_event_id"] for r in rows] == [r["source_event_id"] for r in records]
    assert all(r["pre_reason"] is None for r in rows)
    crossed = [*records[:3], {**records[3], "related_source_event_id": "in2", "hold_duration_ns": 17}]
    bad = {r["source_event_id"]: r["pre_reason"] for r in A.native_events(_lines(spark, crossed)).collect()}
    assert bad["out3"] == "INVALID_EVENT_PAIR" and bad["in2"] is None


def test_cpython_floor(spark):
    def wait(duration):
        return [
            _probe(1, "w", "wait_begin", 2_000, "mutex"),
            _probe(2, "x", "wait_end", 2_000 + duration, "mutex", related_source_event_id="w", duration_ns=duration, result="acquired"),
        ]

    def reason(duration, thresholded):
        rows = A.cpython_events(_lines(spark, wait(duration)), thresholded).collect()
        return {r["source_event_id"]: r["pre_reason"] for r in rows}["x"]

    assert [reason(d, t) for d, t in ((9_999, False), (9_999, True), (10_000, True))] == [None, "INVALID_EVENT_PAIR", None]


def _recorded(kind, start, duration, **values):
    path = [("step", "shop/Cart", None), ("loop", "java/util/Timer", "java.base")]
    frames = [
        {"method": {"name": n, "type": {"name": t, "package": {"module": {"name": m}} if m else None}}} for n, t, m in path
    ]
    thread = {"osThreadId": 310, "javaThreadId": 12, "virtual": False}
    return {"type": f"jdk.{kind}", "values": {"startTime": start, "duration": duration, "eventThread": thread,
                                              "stackTrace": {"truncated": False, "frames": frames}, "address": 5150, **values}}


def test_jfr(spark):
    events = [
        _recorded("JavaMonitorEnter", "2031-02-03T06:00:02.25-01:00", "PT0.004S", previousOwner={"osThreadId": 311, "javaThreadId": 13, "virtual": False}),
        _recorded("JavaMonitorWait", "2031-02-03T07:00:01Z", "PT2.5S", timedOut=True, address=0),
        _recorded("ThreadPark", "2031-02-03T07:00:03.000000001Z", "PT0.000000009S"),
        *[{"type": "jdk.DataLoss", "values": {"amount": n}} for n in (40, 2)],
    ]
    document = json.dumps({"recording": {"events": events}})
    docs = spark.createDataFrame([("c", PID, document)], "capture_id string, target_pid int, document string")
    by_kind = {r["lock_kind"]: r for r in A.jfr_events(docs).collect()}
    # times count from the earliest start, 07:00:01
    assert {k: (r["outcome"], r["duration_ns"], r["ts_ns"]) for k, r in by_kind.items()} == {
        "mutex": ("acquired", 4_000_000, 1_250_000_000 + 4_000_000),
        "condition": ("timed_out", 2_500_000_000, 2_500_000_000),
        "park": ("unknown", 9, 2_000_000_001 + 9),
    }
    assert by_kind["condition"]["source_lock_id"] is None
    frames = by_kind["mutex"]["frames"]
    assert [(f["symbol"], f["module"]) for f in frames] == [("java.util.Timer.loop", "java.base"), ("shop.Cart.step", "unnamed-java-module")]
    assert by_kind["mutex"]["owner_context"] == f"java_platform_thread|{PID}|311|java-thread-13"
    assert A.jfr_lost_bytes(docs).collect()[0]["lost_bytes"] == 42


def test_pprof(spark):
    places = {1: ("sync.(*RWMutex).RUnlock", "sync/rwmutex.go", 30), 2: ("shop.price", "shop/price.go", 9), 3: ("shop.serve", "shop/serve.go", 4)}
    samples = [(6, 1200, [1, 2, 3]), (44, 90, [3])]
    text = ["PeriodType: contentions count", "Period: 1", "Time: 2031-02-03", "Samples:", "contentions/count delay/nanoseconds"]
    text += [f"{n:>9} {ns}: {' '.join(map(str, ids))}" for n, ns, ids in samples]
    text += ["Locations", *[f"{i:>6}: 0x{0x9000 + i:x} M=1 {f} {p}:{line}:0 s=1" for i, (f, p, line) in places.items()]]
    text += ["Mappings", "1: 0x9000/0xa000/0x0 /opt/own/shop"]
    rows = A.pprof_events(_lines(spark, text), "block", PID).orderBy("line_no").collect()
    assert [(r["source_event_id"], r["observed_count"], r["cumulative_wait_ns"]) for r in rows] == [
        (f"go-sample-{i}", n, ns) for i, (n, ns, _) in enumerate(samples, 1)
    ]
    assert [f["symbol"] for f in rows[0]["frames"]] == [places[i][0] for i in (3, 2, 1)]
    assert rows[0]["frames"][2]["source_file"] == "rwmutex.go" and rows[0]["estimated_count"] is None
    assert rows[1]["lock_kind"] == "unknown"
