"""The replay against a second one, a recursive query, over random streams whose rows name each other."""

import random

import duckdb
import pyarrow as pa

from gristmill.operators import runtime_locks as R
from gristmill.plans.replay_sql import replay_sql

from test_ordered import NAMES, STREAM

TARGET = {"wait_end": "wait_begin", "acquire": "wait_end", "release": "acquire"}


def _random_stream(capture, rng, size):
    """Rows that mostly name an open row of the right kind, sometimes any row, a later one or none."""
    names = [f.split()[0] for f in STREAM.split(", ")]
    rows = []
    for i in range(size):
        kind = rng.choice(("wait_begin", "wait_end", "acquire", "acquire", "release", "release"))
        lock_kind = rng.choice(("mutex", R.RECURSIVE))
        row = dict.fromkeys(names) | {
            "capture_id": capture, "event_index": i, "event_id": f"{capture}-{i}", "ts_ns": 10 * i, "context": rng.choice("AAAB"),
            "event_kind": kind, "semantics": "thresholded" if capture % 4 == 0 else "exact", "lock_id": "L", "lock_kind": lock_kind,
            "outcome": rng.choice(("acquired", "acquired", "timed_out")) if kind == "wait_end" else None,
        }
        since = rng.randrange(i + 1)
        if kind in TARGET and rng.random() < 0.6:
            fitting = [r for r in rows if r["event_kind"] == TARGET[kind] and r["lock_kind"] == lock_kind and r["context"] == row["context"]]
            if fitting and rng.random() < 0.8:
                since = rng.choice(fitting[-3:])["event_index"]
            else:
                since = rng.randrange(size + 1)
            row[NAMES[kind]] = f"{capture}-{since}"
        lasted = 10 * max(0, i - since) + rng.choice((0, 0, 0, 1))
        if kind == "wait_end":
            row["duration_ns"] = lasted
        if kind == "release" and rng.random() < 0.8:
            row["hold_duration_ns"] = lasted
        rows.append(row)
    return rows


def test_random_streams(spark):
    rng = random.Random(11)
    names = [f.split()[0] for f in STREAM.split(", ")]
    rows = [r for capture in range(150) for r in _random_stream(capture, rng, 14)]
    replayed = R.replay(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], STREAM))
    con = duckdb.connect()
    source = [
        {k: r[k] for k in ("capture_id", "event_index", "event_id", "ts_ns", "context", "event_kind", "semantics", "lock_kind",
                           "duration_ns", "hold_duration_ns", "outcome")}
        | {"lock_key": r["lock_id"], "ref_id": r[NAMES[r["event_kind"]]] if r["event_kind"] in NAMES else None}
        for r in rows
    ]
    con.register("streams", pa.Table.from_pylist(source))

    def second(table):
        return sorted(con.sql(f"with recursive {replay_sql('streams')} select * from {table}").fetchall(), key=str)

    def first(df, *columns):
        return sorted(map(tuple, df.select("capture_id", *columns).collect()), key=str)

    issues = second("rp_issues")
    assert len({r[2] for r in issues}) == 15  # every reason that waits and holds can have
    assert first(replayed.issues, "phase", "reason", "subject_id", "related_id") == issues
    assert first(replayed.waits, "begin_event_id", "end_event_id") == second("rp_waits")
    assert first(replayed.holds, "acquire_event_id", "release_event_id") == second("rp_holds")
