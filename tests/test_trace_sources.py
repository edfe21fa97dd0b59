"""Trace transcripts and kernel records against hand-written expectations."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from gristmill.functions import trace_codes as C
from gristmill.operators import locks as L
from gristmill.operators import sched as S
from gristmill.sources import trace_ndjson as J
from gristmill.sources import trace_text as T

# the target is process 6 with threads 6 and 7; thread 31 belongs to nobody
T0, MUTEX, OTHER, OLD, WORD = 5, 0xFFFF00A0, 0xFFFF00B0, 0xFFFF00C0, 0x7000BEE0


def _at(ns, event, payload, who="6/7", cpu=1):
    return f"{who} [{cpu:03d}] {T0}.{ns:09d}: {event}: {payload}"


def _switch(ns, out, state, into, **more):
    side = "prev_comm={0} prev_pid={0} prev_prio=120 prev_state={1} ==> next_comm={2} next_pid={2} next_prio=120"
    return _at(ns, "sched:sched_switch", side.format(out, state, into), **more)


def _wake(ns, kind, pid):
    return _at(ns, f"sched:sched_{kind}", f"comm=t{pid} pid={pid} prio=120 target_cpu=0", who="30/31")


SCHED = [
    _switch(1000, 7, "S", 31),
    _wake(1100, "waking", 6), _wake(1150, "waking", 6), _wake(1200, "wakeup_new", 6),  # two wakers: none is named
    _wake(1300, "waking", 7), _wake(1600, "wakeup", 7),
    _switch(2000, 31, "R", 7),
    _switch(2500, 6, "R", 7, who="6/6"),
    _at(2600, "sched:sched_migrate_task", "comm=t7 pid=7 prio=120 orig_cpu=1 dest_cpu=2"),
    _wake(2700, "wakeup", 31),  # foreign
    "PERF_RECORD_LOST lost 19",
    _at(2800, "sched:sched_switch", "prev_comm=x prev_pid=1 prev_pid=7 prev_prio=1 prev_state=S ==> next_comm=y next_pid=31 next_prio=1"),
    _wake(2900, "waking", 7),  # never completed
]


def _lock(ns, event, address, rest=""):
    return _at(ns, f"lock:{event}", f"0x{address:x}{rest}")


LOCK = [
    _lock(10, "contention_begin", MUTEX, " (flags=MUTEX)"),
    _lock(14, "contention_begin", MUTEX, " (flags=SPIN)"),  # a later phase of the same wait
    _lock(35, "contention_end", MUTEX, " (ret=0)"),
    *[_lock(40 + i, "contention_end", MUTEX, f" (ret={ret})") for i, ret in enumerate((-110, -35, -4))],
    _lock(50, "contention_begin", OTHER, " (flags=MUTEX|NEWER)"),
    _lock(51, "contention_end", OTHER, " (ret=0)"),
    _lock(60, "lock_contended", OLD, " name"), _lock(67, "lock_acquired", OLD, " name"),
    _lock(69, "lock_acquire", OLD, " name"), _lock(80, "lock_release", OLD, " name"),
    *[_at(90 + op, "syscalls:sys_enter_futex", f"__syscall_nr: 202, uaddr: 0x{WORD:x}, op: 0x{op:x}, val: 0x1") for op in (0, 1)],
    _at(95, "syscalls:sys_exit_futex", "ret=0"),
    _at(99, "lock:contention_begin", "0xabc (flags=MUTEX)", who="30/31"),
]


def _judged(spark, text, mode):
    rows = [("c", i, line) for i, line in enumerate(text, 1)]
    lines = spark.createDataFrame(rows, "capture_id string, line_no long, line string")
    targets = spark.createDataFrame([("c", 6, [6, 7])], "capture_id string, target_pid int, target_tids array<bigint>")
    return T.judge_trace(T.parse_trace(lines), targets, mode)


def test_scheduler_transcript(spark):
    judged = _judged(spark, SCHED, "sched")
    events = T.scheduler_events(judged)
    rows = events.orderBy("step").collect()
    assert [(r["event_type"], r["tid"]) for r in rows] == [
        ("switch_out", 7), ("wakeup", 6), ("wakeup", 7), ("switch_in", 7), ("switch_out", 6), ("switch_in", 7), ("migrate", 7),
    ]
    c = T.conversion_counters(judged, events, "sched").collect()[0]
    # one row each: forged label, foreign wakeup; unsupported: the ambiguous wakers and the open one
    assert (c["input"], c["lost"], c["malformed"], c["foreign"], c["unsupported"], c["enrichment"]) == (12, 19, 1, 1, 3, 1)
    off = S.off_cpu_intervals(S.transitions(events)).where("tid = 7 and complete").collect()[0]
    assert (off["total_ns"], off["blocked_ns"], off["runnable_ns"], off["category"]) == (1000, 600, 400, "sleep")


def test_lock_transcript(spark):
    judged = _judged(spark, LOCK, "lock")
    key = bytes(range(32))
    events = T.lock_events(judged, key)
    kept = events.where(~F.col("event_type").isin(*T.FOLDED)).orderBy("event_index").collect()
    assert [r["event_type"] for r in kept] == [
        "lock_wait", "acquired", "timed_out", "failed", "interrupted", "unknown", "lock_wait", "acquired", "released",
        "futex_wait", "futex_wake",
    ]
    names = {hmac.new(key, f"0x{a:x}".encode(), hashlib.sha256).hexdigest()[:20]: a for a in (MUTEX, OTHER, OLD, WORD)}
    assert [names[r["lock_id"].removeprefix("lock-")] for r in kept[:9]] == [MUTEX] * 5 + [OTHER] + [OLD] * 3
    c = T.conversion_counters(judged, events, "lock").collect()[0]
    assert (c["input"], c["emitted"], c["foreign"], c["enrichment"]) == (len(LOCK), 11, 1, 1)
    steps = L.lock_steps(events.where(~F.col("event_type").isin(*T.FOLDED)))
    assert sorted((r["duration_ns"], r["outcome"]) for r in L.wait_intervals(steps).collect()) == [(7, "acquired"), (25, "acquired")]
    assert [r["duration_ns"] for r in L.hold_intervals(steps).collect()] == [13]


def test_late_rows_do_not_move_the_clock(spark):
    text = [_at(ns, "sched:sched_migrate_task", "comm=t pid=7 prio=1 orig_cpu=0 dest_cpu=1") for ns in (80, 30, 79, 80, 95)]
    got = [r["disposition"] for r in _judged(spark, text, "sched").orderBy("line_no").collect()]
    assert got == ["accepted", "out_of_order", "out_of_order", "accepted", "accepted"]


def test_kernel_records(spark):
    def rec(seq, ts, kind, tid=7, **more):
        return json.dumps({"schema_version": "1.0", "sequence": seq, "timestamp_ns": ts, "cpu": 0, "kind": kind, "target_tid": tid, **more})

    hidden = {"related_scope": "external_redacted"}
    judged = [
        (rec(0, 500, "sched_switch_out", previous_state=2, **hidden), "accepted"),
        (rec(1, 620, "sched_waking", related_target_tid=6, related_scope="target", target_cpu=0), "accepted"),
        (rec(2, 640, "sched_wakeup", target_cpu=0), "accepted"),
        (rec(3, 639, "sched_wakeup", target_cpu=0), "out_of_order"),
        (rec(4, 700, "sched_switch_in", **hidden), "accepted"),
        (rec(5, 710, "sched_migrate", origin_cpu=0, destination_cpu=3, lock_id="no"), "malformed"),  # a field of another kind
        (rec(8, 720, "sched_wakeup", target_cpu=0), "malformed"),  # a gap in the sequence
        (rec(6, 730, "sched_wakeup", tid=31, target_cpu=0), "malformed"),  # not of the target
        ('{"cpu":1,"cpu":1}', "malformed"),
        ("[", "malformed"),
    ]
    rows = spark.createDataFrame([("c", i, x) for i, (x, _) in enumerate(judged, 1)], "capture_id string, line_no long, line string")
    targets = spark.createDataFrame([("c", [6, 7])], "capture_id string, target_tids array<bigint>")
    parsed = J.parse_kernel_trace(rows, targets, "sched")
    assert [r["disposition"] for r in parsed.orderBy("line_no").collect()] == [d for _, d in judged]
    off = S.off_cpu_intervals(S.transitions(J.kernel_events(parsed))).collect()
    assert [(r["total_ns"], r["blocked_ns"], r["runnable_ns"], r["waker_tid"]) for r in off] == [(200, 140, 60, 6)]


def test_codes(spark):
    df = spark.createDataFrame([("0xffffffffffffffff",), ("-0x10",), ("129",), ("zz",)], "t string")
    assert [r[0] for r in df.select(C.parse_integer(F.col("t"))).collect()] == [-1, -16, 129, None]
    ops = spark.createDataFrame([(0,), (128,), (129,), (137,), (4,)], "o bigint")
    assert [r[0] for r in ops.select(C.futex_kind(F.col("o"))).collect()] == ["futex_wait", "futex_wait", "futex_wake", "futex_wait", None]
    key = b"k" * 80
    got = spark.range(1).select(C.hmac_sha256(key, F.lit("0xAB"))).collect()[0][0]
    assert got == hmac.new(key, b"0xAB", hashlib.sha256).hexdigest()
