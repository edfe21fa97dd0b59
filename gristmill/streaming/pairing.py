"""Pairing state that lives across micro-batches: threads and (thread, lock) subjects.

The state of a key is a handful of values.  Rows of one batch are taken in ``event_index`` order;
rows behind what the key has seen pair with nothing and come out as ``late``.  When a key is silent
past its timeout, what is open is reported as ``trace_end_boundary``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INTERVALS = (
    "capture_id bigint, tid bigint, measure string, start_event_id bigint, wakeup_event_id bigint, end_event_id bigint,"
    " duration_ns bigint, reason string, blocked_ns bigint, runnable_ns bigint"
)
LOCK_PAIRS = (
    "capture_id bigint, tid bigint, lock_id string, measure string, start_event_id bigint, end_event_id bigint,"
    " duration_ns bigint, outcome string"
)
_THREAD_STATE = (
    "last_index bigint, run_id bigint, run_ns bigint, off_id bigint, off_ns bigint, wakes bigint, wake_id bigint, wake_ns bigint, cpu bigint"
)
_LOCK_STATE = "last_index bigint, waits bigint, wait_id bigint, wait_ns bigint, hold_id bigint, hold_ns bigint"
WAIT_ENDS = ("acquired", "timed_out", "interrupted", "failed", "unknown")


def _ordered(batches: Iterator[pd.DataFrame], last: int) -> tuple[pd.DataFrame, list[int]]:
    """The rows of a key to take in order, and the ids of those that come too late."""
    rows = pd.concat(list(batches), ignore_index=True)
    late = rows["event_index"] <= last
    return rows[~late].sort_values("event_index"), [int(x) for x in rows.loc[late, "event_id"]]


def _thread_step(s: dict[str, Any], e: Any, emit) -> None:
    """Advance one thread by one event."""
    if e.event_type == "wakeup":
        s.update(wakes=s["wakes"] + 1, wake_id=e.event_id, wake_ns=e.ts_ns)
    elif e.event_type == "migrate":
        emit("migration", None, None, e.event_id, None, "event")
        s["cpu"] = e.cpu
    elif e.event_type == "switch_out":
        if s["run_id"] is not None:
            emit("runtime", s["run_id"], None, e.event_id, e.ts_ns - s["run_ns"], None)
            s["cpu"] = e.cpu
        if s["off_id"] is not None:
            emit("off_cpu", s["off_id"], None, None, None, "overlapping_switch_out")
        s.update(run_id=None, off_id=e.event_id, off_ns=e.ts_ns, wakes=0)
    elif e.event_type == "switch_in":
        if s["run_id"] is not None:
            s["run_id"] = None
            return
        if s["cpu"] is not None and s["cpu"] != e.cpu:
            emit("migration", None, None, e.event_id, None, "switch_in")
        one = s["wakes"] == 1
        if one:
            emit("runnable", s["wake_id"], None, e.event_id, e.ts_ns - s["wake_ns"], None)
        if s["off_id"] is None:
            emit("off_cpu", None, None, e.event_id, None, "trace_start_boundary")
        else:
            reason = None if one else "missing_wakeup" if s["wakes"] == 0 else "duplicate_wakeup"
            split = (s["wake_ns"] - s["off_ns"], e.ts_ns - s["wake_ns"]) if one else (None, None)
            emit("off_cpu", s["off_id"], s["wake_id"] if one else None, e.event_id, e.ts_ns - s["off_ns"], reason, *split)
        s.update(run_id=e.event_id, run_ns=e.ts_ns, off_id=None, wakes=0)


def _pair_threads(silence_ms: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names = [f.strip().split(" ")[0] for f in _THREAD_STATE.split(",")]
    s = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names)
    s["wakes"], s["last_index"] = s["wakes"] or 0, -1 if s["last_index"] is None else s["last_index"]
    out: list[tuple] = []

    def emit(measure, start, wake, end, duration, reason, blocked=None, runnable=None) -> None:
        out.append((*key, measure, start, wake, end, duration, reason, blocked, runnable))

    if state.hasTimedOut:
        if s["run_id"] is not None:
            emit("runtime", s["run_id"], None, None, None, "trace_end_boundary")
        if s["off_id"] is not None or s["wakes"]:
            emit("off_cpu", s["off_id"], None, None, None, "trace_end_boundary")
        state.remove()
    else:
        rows, late = _ordered(batches, s["last_index"])
        for event_id in late:
            emit("late", None, None, event_id, None, "late_row")
        for e in rows.itertuples(index=False):
            _thread_step(s, e, emit)
            s["last_index"] = int(e.event_index)
        state.update(tuple(None if s[n] is None else int(s[n]) for n in names))
        _arm(state, rows, silence_ms)
    yield _frame(out, INTERVALS)


def _lock_step(s: dict[str, Any], e: Any, emit) -> None:
    """Advance one (thread, lock) subject by one event."""
    if e.event_type == "lock_wait":
        s.update(waits=s["waits"] + 1, wait_id=e.event_id, wait_ns=e.ts_ns)
    elif e.event_type in WAIT_ENDS:
        if s["waits"] == 1:
            emit("wait", s["wait_id"], e.event_id, e.ts_ns - s["wait_ns"], e.event_type)
        s["waits"] = 0
        if e.event_type == "acquired":
            opened = s["hold_id"] is None
            s.update(hold_id=e.event_id if opened else None, hold_ns=e.ts_ns if opened else None)
    elif e.event_type == "released" and s["hold_id"] is not None:
        emit("hold", s["hold_id"], e.event_id, e.ts_ns - s["hold_ns"], None)
        s["hold_id"] = None


def _pair_locks(silence_ms: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names = [f.strip().split(" ")[0] for f in _LOCK_STATE.split(",")]
    s = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names)
    s["waits"], s["last_index"] = s["waits"] or 0, -1 if s["last_index"] is None else s["last_index"]
    out: list[tuple] = []

    def emit(*values) -> None:
        out.append((*key, *values))

    if state.hasTimedOut:
        if s["waits"]:
            emit("wait", s["wait_id"], None, None, "trace_end_boundary")
        if s["hold_id"] is not None:
            emit("hold", s["hold_id"], None, None, "trace_end_boundary")
        state.remove()
    else:
        rows, late = _ordered(batches, s["last_index"])
        for event_id in late:
            emit("late", None, event_id, None, "late_row")
        for e in rows.itertuples(index=False):
            _lock_step(s, e, emit)
            s["last_index"] = int(e.event_index)
        state.update(tuple(None if s[n] is None else int(s[n]) for n in names))
        _arm(state, rows, silence_ms)
    yield _frame(out, LOCK_PAIRS)


# an hour: how long a key may be silent, in event time, before it is closed
SILENCE_MS = 3_600_000


def _arm(state: GroupState, rows: pd.DataFrame, silence_ms: int) -> None:
    """Close the key once the watermark has left its last event ``silence_ms`` behind."""
    last_ms = int(rows["ts_ns"].max() // 1_000_000) if len(rows) else 0
    state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + silence_ms)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    columns = [f.strip().split(" ") for f in schema.split(",")]
    df = pd.DataFrame(rows, columns=[name for name, _ in columns])
    return df.astype({name: "Int64" for name, kind in columns if kind == "bigint"})


def stream_thread_intervals(events: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """Run, runnable and off-CPU intervals and migrations of a scheduler stream with a watermark.

    ``silence_ms`` must exceed the longest pause of a thread that shall still pair.
    """
    return events.groupBy("capture_id", "tid").applyInPandasWithState(
        partial(_pair_threads, silence_ms), INTERVALS, _THREAD_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_lock_pairs(events: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """Lock waits and holds of a lock stream with a watermark."""
    return events.groupBy("capture_id", "tid", "lock_id").applyInPandasWithState(
        partial(_pair_locks, silence_ms), LOCK_PAIRS, _LOCK_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
