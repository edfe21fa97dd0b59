"""Ordered operators against plain-Python restatements, with plain windows and with spans."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.operators import distribution as D
from gristmill.operators import locks as L
from gristmill.operators import ordered as O
from gristmill.operators import runtime_locks as R
from gristmill.operators import sched as S
from gristmill.plans import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["whole", "spans"])
def mode(request, monkeypatch):
    """``spans``: spans hold few rows, so every key has many."""
    if request.param == "spans":
        for module in (S, L, R):
            monkeypatch.setattr(module, "SPAN_ROWS", 7)
    return request.param


def _captures(df):
    rows = defaultdict(list)
    for r in df.orderBy("capture_id", "event_index").collect():
        rows[r["capture_id"]].append(r.asDict())
    return rows


def test_running_equals_plain_window(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, rng.randint(-5, 9), rng.random() < 0.2) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, i long, v long, r boolean")
    value = F.when(F.col("v") > 0, F.col("v"))
    specs = {}
    for inclusive in (True, False):
        specs |= {
            f"s{inclusive}": O.running_sum(F.col("v"), inclusive),
            f"m{inclusive}": O.running_max(value, inclusive),
            f"n{inclusive}": O.Running("min", value, inclusive),
            f"l{inclusive}": O.running_last(value, inclusive),
            f"c{inclusive}": O.count_since(value > 2, F.col("r"), inclusive),
        }
    cut = {(r["g"], r["i"]): r for r in O.running(df, ["g"], "i", specs, 13).collect()}
    assert len(cut) == 400
    for g, i, *_ in rows:
        for inclusive in (True, False):
            seen = [r for r in rows if r[0] == g and (r[1] < i or inclusive and r[1] == i)]
            positive = [r[2] for r in seen if r[2] > 0]
            last_reset = max((r[1] for r in seen if r[3]), default=-1)
            want = {
                "s": sum(r[2] for r in seen), "m": max(positive, default=None), "n": min(positive, default=None),
                "l": positive[-1] if positive else None, "c": sum(r[2] > 2 for r in seen if r[1] > last_reset),
            }
            assert {k: cut[g, i][f"{k}{inclusive}"] for k in want} == want


def test_running_values_share_their_windows(spark):
    # rows pass one window for the running sums and one for all other values, however many are asked for
    rows = spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    odd, third = F.col("o") % 5 == 1, F.col("o") % 3 == 0
    specs = {f"s{i}": O.count_since(odd, third, inclusive=False) for i in range(3)}
    specs |= {"l": O.running_last(F.when(odd, F.col("o")), inclusive=False), "m": O.running_max(F.col("o"), inclusive=False)}
    plan = O.running(rows, ["k"], "o", specs, 7)._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window [" in line and "[k#" in line and "__span" in line.split("], [k#")[1].split("]")[0]]
    assert len(over_rows) <= 4  # twice: for the rows and for what spans hand on


def test_dense_index(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 500).alias("t"))
    out = O.dense_index(df, ["g"], ["t"], F.floor(F.col("t") / 50))
    for g in (0, 1):
        rows = [r["event_index"] for r in out.where(f"g = {g}").orderBy("t").collect()]
        assert rows == list(range(250))


def test_distributions_are_nearest_rank(spark):
    rng = random.Random(3)
    groups = {n: [rng.randint(0, 10 ** rng.randint(1, 15)) for _ in range(n)] for n in (1, 2, 3, 19, 20, 21, 100, 101)}
    rows = [(n, v) for n, values in groups.items() for v in values]
    got = {r["n"]: r for r in D.distributions(spark.createDataFrame(rows, "n int, v long"), ["n"], "v").collect()}
    for n, values in groups.items():
        values.sort()
        r = got[n]
        assert (r["sample_count"], r["total_ns"], r["minimum_ns"], r["max_ns"]) == (n, sum(values), values[0], values[-1])
        assert r["mean_ns"] == sum(values) // n
        for p in (50, 95, 99):
            assert r[f"p{p}_ns"] == values[(p * n + 99) // 100 - 1]


def test_medians(spark):
    rng = random.Random(4)
    groups = {n: [rng.uniform(-1e6, 1e6) for _ in range(n)] for n in (1, 2, 5, 8)}
    rows = [(n, v) for n, values in groups.items() for v in values]
    got = {r["n"]: r["median"] for r in D.medians(spark.createDataFrame(rows, "n int, v double"), ["n"], "v").collect()}
    for n, values in groups.items():
        values.sort()
        assert got[n] == (values[(n - 1) // 2] + values[n // 2]) / 2


def _segments(rows, ends):
    """Rows cut after each row for which ``ends`` holds; what follows the last one is a segment without end."""
    found = [[]]
    for r in rows:
        found[-1].append(r)
        if ends(r):
            found.append([])
    return found


def _counted(switches):
    """The switches that count: of switch-ins without a switch-out between, every second one only voids."""
    streak, kept = 0, []
    for s in switches:
        streak = streak + 1 if s["event_type"] == "switch_in" else 0
        kept += [s] if streak % 2 or not streak else []
    return kept


def test_sched(spark, mode):
    events = views.sched_events(spark, SF).withColumn("tid", F.col("tid") % 4).cache()
    steps = S.transitions(events)
    by_thread = defaultdict(list)
    for r in events.orderBy("capture_id", "event_index").collect():
        by_thread[r["capture_id"], r["tid"]].append(r)

    def rows_of(frame, *names):
        found = defaultdict(set)
        for r in frame.collect():
            found[r["capture_id"], r["tid"]].add(tuple(r[n] for n in names))
        return found

    runs = rows_of(S.runtime_intervals(steps), "switch_in_event_id", "switch_out_event_id")
    lats = rows_of(S.runnable_latencies(steps), "wakeup_event_id", "switch_in_event_id")
    offs = rows_of(S.off_cpu_intervals(steps), "switch_out_event_id", "wakeup_event_id", "switch_in_event_id", "wakeup_count", "incomplete_reason")
    moves = {(r["capture_id"], r["tid"]): r["migration_count"] for r in S.thread_summary(steps).collect()}
    assert len({c for c, _ in by_thread}) == 5
    for thread, rows in by_thread.items():
        switches = [r for r in rows if r["event_type"].startswith("switch")]
        counted = {r["event_id"] for r in _counted(switches)}
        pairs = zip(switches, switches[1:])
        assert runs[thread] == {
            (a["event_id"], b["event_id"]) for a, b in pairs
            if (a["event_type"], b["event_type"]) == ("switch_in", "switch_out") and a["event_id"] in counted
        }
        before, want_lats, want_offs = None, set(), set()
        for part in _segments(rows, lambda r: r["event_id"] in counted):
            wakes = [r["event_id"] for r in part if r["event_type"] == "wakeup"]
            last = part[-1] if part and part[-1]["event_id"] in counted else None
            one = wakes[0] if len(wakes) == 1 else None
            out = before and before["event_type"] == "switch_out" and before["event_id"] or None
            is_in = last is not None and last["event_type"] == "switch_in"
            if is_in and one is not None:
                want_lats.add((one, last["event_id"]))
            if is_in:
                many = "duplicate_wakeup" if wakes else "missing_wakeup"
                reason = "trace_start_boundary" if out is None else None if one is not None else many
                want_offs.add((out, one, last["event_id"], len(wakes), reason))
            elif last is not None and out is not None:
                want_offs.add((out, one, None, len(wakes), "overlapping_switch_out"))
            elif last is None and (out is not None or wakes):
                want_offs.add((out, one, None, len(wakes), "trace_end_boundary"))
            before = last
        assert lats[thread] == want_lats and offs[thread] == want_offs
        known = [
            (r["cpu"], r["event_type"]) for r in rows
            if r["event_type"] == "migrate" or r["event_id"] in counted and r["event_type"] == "switch_in"
            or any(r["event_id"] == b for _, b in runs[thread])
        ]
        jumps = sum(b[1] == "switch_in" and a[1] != "switch_in" and a[0] != b[0] for a, b in zip(known, known[1:]))
        again = [i for i, (_, kind) in enumerate(known) if kind == "switch_in"]
        for i, j in zip(again, again[1:]):  # a voided run leaves the place known before it
            if j == i + 1:
                earlier = [c for c, kind in known[:j] if kind != "switch_in"]
                jumps += bool(earlier) and earlier[-1] != known[j][0]
        assert moves.get(thread, 0) == jumps + sum(r["event_type"] == "migrate" for r in rows)


def test_locks(spark, mode):
    events = views.lock_events(spark, SF).cache()
    steps = L.lock_steps(events)
    waits = {(r["wait_event_id"], r["wait_end_event_id"]) for r in L.wait_intervals(steps).collect()}
    holds = {(r["acquired_event_id"], r["released_event_id"]) for r in L.hold_intervals(steps).collect()}
    by_subject = defaultdict(list)
    for r in events.where(~L.is_candidate()).orderBy("capture_id", "event_index").collect():
        by_subject[r["capture_id"], r["tid"], r["lock_id"]].append(r)
    want_waits, want_holds = set(), set()
    for rows in by_subject.values():
        for part in _segments(rows, lambda r: r["event_type"] in L.WAIT_ENDS):
            begun = [r["event_id"] for r in part if r["event_type"] == "lock_wait"]
            if part and part[-1]["event_type"] in L.WAIT_ENDS and len(begun) == 1:
                want_waits.add((begun[0], part[-1]["event_id"]))
        for part in _segments(rows, lambda r: r["event_type"] == "released"):
            taken = [r["event_id"] for r in part if r["event_type"] == "acquired"]
            if part and part[-1]["event_type"] == "released" and len(taken) % 2:
                want_holds.add((taken[-1], part[-1]["event_id"]))
    assert waits == want_waits and holds == want_holds and waits and holds


NAMES = {"wait_end": "wait_begin_event_id", "acquire": "wait_end_event_id", "release": "acquire_event_id"}


def _check_replay(rows, issues, waits, holds, consumed):
    """What any right replay keeps: pairs are legal, used once and complete; every issue has a reason.

    ``consumed`` are the rows that were used; a release of a stream that is not exact is used up without a hold.
    """
    row = {r["event_id"]: r for r in rows}
    subject = lambda r: (r["context"], r["lock_id"], r["lock_kind"])
    reported = defaultdict(set)
    for _, reason, subject_id, related_id in issues:
        assert subject_id in row
        reported[subject_id].add(reason)
        reported[related_id].add(reason)
    for pairs, kinds, name in ((waits, ("wait_begin", "wait_end"), "wait_begin_event_id"), (holds, ("acquire", "release"), "acquire_event_id")):
        whole = [(a, b) for a, b in pairs if a is not None and b is not None and row[b]["event_kind"] == kinds[1]]
        assert len({a for a, _ in whole}) == len({b for _, b in whole}) == len(whole)
        for a, b in whole:
            first, second = row[a], row[b]
            assert (first["event_kind"], second["event_kind"]) == kinds and first["event_index"] < second["event_index"]
            assert subject(first) == subject(second)
            assert second[name] in (None, a)
        paired = {b for _, b in pairs} | {a for a, _ in pairs}
        for r in rows:  # what names another row is paired with it, or it is said why not
            if r["event_kind"] == kinds[1] and r[name] is not None and r["event_id"] not in paired:
                assert reported[r["event_id"]] or (r["event_id"] in consumed and r["semantics"] != "exact"), r
        for r in rows:  # a row that names one that does not exist is reported
            if r["event_kind"] == kinds[1] and r[name] is not None and r[name] not in row:
                assert r["event_id"] not in paired and reported[r["event_id"]]
    # without references and nesting, nothing stands between the rows of a pair that could have been paired
    for a, b in holds:
        if a is None or b is None or row[b]["acquire_event_id"] is not None or row[a]["lock_kind"] == "recursive_mutex":
            continue
        between = [
            r for r in rows if subject(r) == subject(row[a]) and row[a]["event_index"] < r["event_index"] < row[b]["event_index"]
            and r["event_kind"] in ("acquire", "release") and r["acquire_event_id"] is None and r["event_id"] not in reported
        ]
        assert not between


def _replayed(df):
    result = R.replay(df)
    issues, waits, holds = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in result.issues.collect():
        issues[r["capture_id"]].append((r["phase"], r["reason"], r["subject_id"], r["related_id"]))
    for r in result.waits.collect():
        waits[r["capture_id"]].append((r["begin_event_id"], r["end_event_id"]))
    for r in result.holds.collect():
        holds[r["capture_id"]].append((r["acquire_event_id"], r["release_event_id"]))
    consumed = defaultdict(set)
    for r in result.dispositions.where("disposition = 'consumed'").collect():
        consumed[r["capture_id"]].add(r["event_id"])
    return issues, waits, holds, consumed


@pytest.mark.parametrize("references", [False, True])
def test_runtime_replay(spark, mode, references):
    events = views.runtime_lock_events(spark, SF, references).withColumn("event_id", F.col("event_id").cast("string"))
    for name in NAMES.values():
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("string"))
    events = O.cut(events)
    issues, waits, holds, consumed = _replayed(events)
    for capture, rows in _captures(events).items():
        _check_replay(rows, issues[capture], waits[capture], holds[capture], consumed[capture])
    assert sum(map(len, waits.values())) and sum(map(len, holds.values()))


STREAM = (
    "capture_id int, event_index long, event_id string, ts_ns long, context string, event_kind string, semantics string, "
    "lock_id string, lock_kind string, parked_context string, wait_begin_event_id string, wait_end_event_id string, "
    "acquire_event_id string, duration_ns long, hold_duration_ns long, outcome string"
)


def _stream(spark, rows):
    """Rows given as (id, kind, lock kind, named id); times are ten apart and durations fit them."""
    names = [f.split()[0] for f in STREAM.split(", ")]
    at, full = {}, []
    for i, (event_id, kind, lock_kind, named) in enumerate(rows):
        at[event_id] = 10 * i
        row = dict.fromkeys(names) | {
            "capture_id": 1, "event_index": i, "event_id": event_id, "ts_ns": 10 * i, "context": "A", "event_kind": kind,
            "semantics": "exact", "lock_id": "L", "lock_kind": lock_kind, "outcome": "acquired" if kind == "wait_end" else None,
        }
        if named:
            row[NAMES[kind]] = named
            lasted = 10 * i - at.get(named, 0)
            row |= {"duration_ns": lasted} if kind == "wait_end" else {"hold_duration_ns": lasted} if kind == "release" else {}
        full.append(row)
    return full, spark.createDataFrame([tuple(r[n] for n in names) for r in full], STREAM)


# small streams, what they pair, and the reasons they report
NEST = "recursive_mutex"
CASES = [
    ([("b", "wait_begin", "mutex", None), ("e", "wait_end", "mutex", "b"), ("a", "acquire", "mutex", "e"), ("r", "release", "mutex", "a")],
     {("b", "e")}, {("a", "r")}, set()),
    ([("a", "acquire", "mutex", None), ("r", "release", "mutex", "a"), ("q", "release", "mutex", "a")], set(), {("a", "r")}, {"reused_acquire"}),
    ([("r", "release", "mutex", "gone")], set(), set(), {"unknown_acquire"}),
    ([("e", "wait_end", "mutex", "gone")], set(), set(), {"unknown_wait_begin"}),
    ([("a", "acquire", NEST, None), ("c", "acquire", NEST, None), ("d", "release", NEST, "c"), ("r", "release", NEST, "a")],
     set(), {("a", "r"), ("c", "d")}, set()),
    ([("a", "acquire", NEST, None), ("c", "acquire", NEST, None), ("r", "release", NEST, "a")], set(), set(), {"non_lifo_release"}),
    ([("a", "acquire", NEST, None), ("r", "release", "mutex", "a")], set(), set(), {"hold_identity_mismatch"}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_small_streams(spark, case):
    given, want_waits, want_holds, reasons = CASES[case]
    rows, df = _stream(spark, given)
    issues, waits, holds, consumed = _replayed(df)
    assert (set(waits[1]), set(holds[1])) == (want_waits, want_holds)
    assert reasons <= {r for _, r, _, _ in issues[1]}
    _check_replay(rows, issues[1], waits[1], holds[1], consumed[1])


def _random_stream(seed, n):
    """A stream whose rows name right, wrong, used and missing rows, with nested locks."""
    rng, rows, now = random.Random(seed), [], 0
    targets = {"wait_end": "wait_begin", "acquire": "wait_end", "release": "acquire"}
    for i in range(n):
        now += rng.randint(0, 3)
        kind = rng.choice(["wait_begin", "wait_end", "acquire", "acquire", "release", "release"])
        lock_kind = rng.choice(["mutex", "recursive_mutex", "recursive_mutex"])
        row = {
            "capture_id": 1, "event_index": i, "event_id": str(i), "ts_ns": now, "context": rng.choice("AB"), "event_kind": kind,
            "semantics": "exact", "lock_id": "L", "lock_kind": lock_kind, "parked_context": None, "wait_begin_event_id": None,
            "wait_end_event_id": None, "acquire_event_id": None, "duration_ns": None, "hold_duration_ns": None,
            "outcome": rng.choice(["acquired", "acquired", "timed_out"]) if kind == "wait_end" else None,
        }
        same = [r for r in rows if r["event_kind"] == targets.get(kind) and (r["context"], r["lock_kind"]) == (row["context"], lock_kind)]
        named = None
        if kind in targets and rng.random() < 0.6:
            named = rng.choice(same[-3:]) if same and rng.random() < 0.8 else rng.choice(rows[-8:]) if rows else None
        name = {"wait_end": "wait_begin_event_id", "acquire": "wait_end_event_id", "release": "acquire_event_id"}.get(kind)
        if named:
            row[name] = named["event_id"]
        start = named or (same[-1] if same else None)
        lasted = (now - start["ts_ns"] if start else 5) + (rng.random() < 0.1)
        if kind == "wait_end":
            row["duration_ns"] = lasted
        elif kind == "release" and rng.random() < 0.8:
            row["hold_duration_ns"] = lasted
        rows.append(row)
    return rows


def test_random_references(spark, mode):
    rows = _random_stream(2, 160)
    names = [f.split()[0] for f in STREAM.split(", ")]
    issues, waits, holds, consumed = _replayed(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], STREAM))
    _check_replay(rows, issues[1], waits[1], holds[1], consumed[1])
    assert {"non_lifo_release", "hold_identity_mismatch", "reused_acquire"} <= {r for _, r, _, _ in issues[1]}
