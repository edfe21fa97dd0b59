import json

import pytest
from pyspark.sql import functions as F

from gristmill.sources import probe_files as P

LINES = "capture_id string, line_no long, line string"
FRAME = {"symbol": "f", "module": "m", "source_file": "/a.c", "source_line": 3, "is_runtime": False, "is_unknown": False}


def native():
    """A nested wait and hold on one lock, then a release of the outer one."""
    header = {
        "schema_version": "1.0", "record_type": "probe_header", "protocol": "native_pthread_probe", "protocol_version": "1.0", "runtime": "c_cpp", "runtime_version": "9",
        "adapter_id": "native-pthread", "adapter_version": "1", "backend_id": "ld-preload", "backend_version": "1", "pid": 7, "uid": 0, "target_start_time_ticks": 4,
        "observed_target_tids": [7, 8], "target_kind": "host", "container_reference": None, "semantics": "exact", "duration_threshold_ns": None, "max_events": 100,
        "visible_lock_kinds": ["mutex", "recursive_mutex"], "fast_path_visibility": "complete", "owner_is_source_observed": False, "hold_time_is_source_observed": True,
    }
    stack = {"schema_version": "1.0", "record_type": "probe_stack", "stack_id": "s1", "frames": [FRAME, dict(FRAME, source_file=None, source_line=None)]}
    shape = [
        ("wait_begin", None, None, None, "unknown", 10), ("wait_end", 1, 5, None, "acquired", 15), ("acquire", 2, None, None, "acquired", 15),
        ("acquire", None, None, None, "acquired", 20), ("release", 4, None, 10, "released", 30), ("release", 3, None, 25, "released", 40),
    ]
    events = [
        {
            "schema_version": "1.0", "record_type": "probe_event", "sequence": i, "source_event_id": f"e{i}", "event_kind": kind, "timestamp_ns": at, "pid": 7, "tid": 8,
            "raw_lock_token": "00000000000000ab", "lock_kind": "recursive_mutex", "related_source_event_id": named and f"e{named}", "duration_ns": lasted, "hold_duration_ns": held,
            "result": result, "stack_id": "s1" if i % 2 else None,
        }
        for i, (kind, named, lasted, held, result, at) in enumerate(shape, 1)
    ]
    footer = {"schema_version": "1.0", "record_type": "probe_footer", "protocol": "native_pthread_probe", "pid": 7, "sequence": 7, "declared_event_count": 6, "lost_event_count": 2, "truncated": False}
    return [header, stack, *events, footer]


def change(place, **fields):
    def run(records):
        records[place] = {k: v for k, v in (records[place] | fields).items() if v != "drop"}
        return records
    return run


def insert(place, record):
    return lambda records: [*records[:place], record, *records[place:]]


# what is done to the file, the reason and the line it must be refused for
CASES = [
    (lambda r: r, None, None),
    (lambda r: r[:-1], "MISSING_FOOTER", None),
    (lambda r: r[1:], "HEADER_NOT_FIRST", 1),
    (insert(1, native()[0]), "DUPLICATE_HEADER", 2),
    (insert(9, native()[1]), "RECORD_AFTER_FOOTER", 10),
    (insert(2, native()[1]), "DUPLICATE_STACK", 3),
    (insert(4, dict(native()[1], stack_id="s2")), "STACK_AFTER_EVENT", 5),
    (insert(3, {"record_type": "other"}), "UNKNOWN_RECORD", 4),
    (insert(3, "no json"), "INVALID_JSON", 4),
    (insert(3, ""), "INVALID_JSON", 4),
    (insert(3, [1]), "INVALID_JSON", 4),
    (change(0, uid="drop"), "INVALID_HEADER", 1),
    (change(0, extra=1), "INVALID_HEADER", 1),
    (change(0, observed_target_tids=[8, 9]), "INVALID_HEADER", 1),
    (change(0, visible_lock_kinds=["recursive_mutex", "mutex"]), "INVALID_HEADER", 1),
    (change(0, target_kind="docker"), "INVALID_HEADER", 1),
    (change(0, semantics="thresholded"), "INVALID_HEADER", 1),
    (change(0, max_events=30_000), "INVALID_HEADER", 1),
    (change(0, max_events=3), "EVENT_BUDGET_EXCEEDED", 6),
    (change(0, semantics="thresholded", duration_threshold_ns=6, fast_path_visibility="partial"), "INVALID_EVENT_PAIR", 4),
    (change(0, semantics="thresholded", duration_threshold_ns=5, fast_path_visibility="partial"), None, None),
    (change(0, hold_time_is_source_observed=False), "INVALID_EVENT_PAIR", 7),
    (change(1, frames=[]), "INVALID_STACK", 2),
    (change(1, frames=[dict(FRAME, source_file=None)]), "INVALID_STACK", 2),
    (change(1, stack_id="x1"), "INVALID_STACK", 2),
    (change(1, stack_id="s7"), "UNKNOWN_STACK", 3),
    (change(2, sequence=0), "INVALID_EVENT", 3),
    (change(2, result="acquired"), "INVALID_EVENT", 3),
    (change(3, duration_ns=None), "INVALID_EVENT", 4),
    (change(3, duration_ns=4), "INVALID_EVENT_PAIR", 4),
    (change(3, related_source_event_id="e3"), "INVALID_EVENT_PAIR", 4),
    (change(4, related_source_event_id="e1"), "INVALID_EVENT_PAIR", 5),
    (change(3, result="timed_out"), "INVALID_EVENT_PAIR", 5),
    (change(6, related_source_event_id="e3", hold_duration_ns=15), "INVALID_EVENT_PAIR", 7),
    (change(7, hold_duration_ns=None), "INVALID_EVENT_PAIR", 8),
    (change(5, pid=9), "OUTSIDE_TARGET", 6),
    (change(5, lock_kind="condition"), "UNDECLARED_LOCK_KIND", 6),
    (change(5, lock_kind="mutex"), "LOCK_KIND_CHANGED", 6),
    (change(5, timestamp_ns=14), "TIME_REVERSED", 6),
    (change(5, tid=7), "INVALID_EVENT_PAIR", 7),
    (lambda r: r[:4] + r[5:], "SEQUENCE_GAP", 5),
    (change(8, pid=8), "OUTSIDE_TARGET", 9),
    (change(8, sequence=6), "SEQUENCE_GAP", 9),
    (change(8, declared_event_count=7), "EVENT_COUNT_MISMATCH", 9),
    (change(8, truncated=None), "INVALID_FOOTER", 9),
    (lambda r: [r[0], dict(r[-1], sequence=1, declared_event_count=0)], None, None),
    (lambda r: [r[0], dict(r[-1], sequence=1, declared_event_count=0, truncated=True)], "INVALID_FOOTER", 2),
    (lambda r: [r[0]], "MISSING_FOOTER", None),
]


def judged(spark, files, form):
    rows = [(name, 10 * n, x if isinstance(x, str) else json.dumps(x)) for name, records in files.items() for n, x in enumerate(records, 1)]
    return P.read_probe(spark.createDataFrame(rows, LINES).repartition(5), form)


def test_every_rule_of_native_files(spark):
    files = {str(i): change_it([dict(r) for r in native()]) for i, (change_it, _, _) in enumerate(CASES)}
    found = {r.capture_id: r for r in judged(spark, files, P.NATIVE).captures.collect()}
    got = {i: (found[i].reason, found[i].line_no and found[i].line_no // 10) for i in files}
    assert got == {str(i): (reason, line) for i, (_, reason, line) in enumerate(CASES)}
    assert all(r.accepted == (r.reason is None) for r in found.values())
    whole = found["0"]
    assert (whole.lines, whole.stacks, whole.events, whole.threads, whole.declared_events, whole.lost_events, whole.hold_observed) == (9, 1, 6, 1, 6, 2, True)


def test_events_and_stacks_of_accepted_files(spark):
    files = judged(spark, {"good": native(), "cut": native()[:-1]}, P.NATIVE)
    events = {r.source_event_id: r for r in P.accepted_events(files).collect()}
    assert len(events) == 6 and {r.capture_id for r in events.values()} == {"good"}
    assert events["e2"].wait_begin_source_event_id == "e1" and events["e3"].wait_end_source_event_id == "e2" and events["e6"].acquire_source_event_id == "e3"
    assert (events["e2"].duration_ns, events["e6"].hold_duration_ns, events["e6"].context) == (5, 25, "os_thread|7|8|")
    assert [(r.capture_id, r.depth, r.source_line) for r in P.accepted_stacks(files).orderBy("depth").collect()] == [("good", 0, 3), ("good", 1, None)]


def cpython():
    header = {
        "schema_version": "1.0", "record_type": "cpython_header", "protocol": "cpython_threading_probe", "protocol_version": "1.0", "runtime_version": "3.13.2", "free_threaded": False,
        "pid": 7, "uid": 0, "target_start_time_ticks": 4, "semantics": "exact", "duration_threshold_ns": None, "max_events": 9,
        "visible_lock_kinds": ["condition", "mutex", "recursive_mutex", "semaphore"],
    }
    event = {"schema_version": "1.0", "record_type": "cpython_event", "pid": 7, "tid": 7, "raw_lock_token": "lock-1", "lock_kind": "mutex", "duration_ns": None}
    events = [
        event | {"sequence": 1, "source_event_id": "event-1", "event_kind": "wait_begin", "timestamp_ns": 5, "result": "unknown"},
        event | {"sequence": 2, "source_event_id": "event-2", "event_kind": "wait_end", "timestamp_ns": 9, "related_source_event_id": "event-1", "duration_ns": 4, "result": "acquired"},
        event | {"sequence": 3, "source_event_id": "event-3", "event_kind": "acquire", "timestamp_ns": 9, "related_source_event_id": "event-2", "result": "acquired"},
        event | {"sequence": 4, "source_event_id": "event-4", "event_kind": "release", "timestamp_ns": 12, "result": "released", "stack_id": None},
    ]
    footer = {
        "schema_version": "1.0", "record_type": "cpython_footer", "protocol": "cpython_threading_probe", "pid": 7, "sequence": 4, "declared_event_count": 4, "lost_event_count": 0,
        "truncated": False, "observed_target_tids": [7],
    }
    return [header, *events, footer]


def test_cpython_files(spark):
    cases = [
        (lambda r: r, None), (change(0, runtime_version="3.11.1"), "INVALID_HEADER"), (change(0, semantics="thresholded", duration_threshold_ns=10_000), "INVALID_EVENT_PAIR"),
        (change(4, related_source_event_id="event-3"), "INVALID_EVENT"), (change(3, related_source_event_id=None), "INVALID_EVENT"), (change(2, result="failed"), "INVALID_EVENT"),
        (change(5, observed_target_tids=[8]), "INVALID_FOOTER"), (lambda r: [*r[:2], dict(r[5], sequence=1, declared_event_count=1)], "OPEN_WAIT_AT_END"),
        (lambda r: [*r[:2], dict(r[5], sequence=1, declared_event_count=1, truncated=True)], None), (change(5, sequence=5), "SEQUENCE_GAP"),
    ]
    files = {str(i): change_it([dict(r) for r in cpython()]) for i, (change_it, _) in enumerate(cases)}
    found = {r.capture_id: r.reason for r in judged(spark, files, P.CPYTHON).captures.collect()}
    assert found == {str(i): reason for i, (_, reason) in enumerate(cases)}


@pytest.mark.parametrize("form", [P.NATIVE, P.CPYTHON])
def test_no_lines(spark, form):
    files = P.read_probe(spark.createDataFrame([], LINES), form)
    assert files.captures.isEmpty() and files.problems.isEmpty() and P.accepted_events(files, form).isEmpty()
    alone = P.read_probe(spark.createDataFrame([("a", 1, None), (None, 1, "{}")], LINES), form)
    assert {r.capture_id: r.reason for r in alone.captures.where(F.col("capture_id").isNotNull()).collect()} == {"a": "INVALID_JSON"}
