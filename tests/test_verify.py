import random
from decimal import Decimal

from pyspark.sql import functions as F

from gristmill.operators import verify as V

EVENTS = "capture_id int, event_index long, event_id long, ts_ns long, tid long, cpu long, waker_tid long"


def rows_of(df):
    return {(r["capture_id"], r["check"]): (r["checked"], r["failures"]) for r in df.collect()}


def test_previous_over_many_partitions(spark):
    """One capture holds nearly all rows and many of them the same index."""
    rng = random.Random(1)
    rows = [(1, rng.choice([0, 0, i]), i, rng.randrange(10**6), 1, 0, None) for i in range(4000)] + [(2, 0, 9000, 5, 1, 0, None), (3, 7, 9001, 5, 1, 0, None)]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = V.with_previous(spark.createDataFrame(rows, EVENTS).repartition(7), ["event_index", "event_id"], F.col("ts_ns")).cache()
        parts = found.select("event_id", F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert parts
    want, before = {}, None
    for r in sorted(rows, key=lambda r: r[:3]):
        want[r[2]] = before[3] if before and before[0] == r[0] else None
        before = r
    assert {r["event_id"]: r["previous"] for r in found.collect()} == want


def test_events_without_fault_and_each_fault(spark):
    good = [(c, i, 100 * c + i, 1000 + 10 * i, 1 + i % 2, 0, None if i % 3 else 2) for c in (1, 2) for i in range(50)]
    scope = spark.createDataFrame([(1, 1000, 1490, [1, 2]), (2, 1000, 1490, [1, 2])], "capture_id int, start_ns long, end_ns long, target_tids array<bigint>")

    def broken(change):
        rows = [change(list(r)) for r in good]
        found = rows_of(V.event_checks(spark.createDataFrame([tuple(r) for r in rows if r], EVENTS), scope))
        assert all(n == 50 for (c, _), (n, _) in found.items() if c == 2)
        assert not any(f for (c, _), (_, f) in found.items() if c == 2)
        return {check: f for (c, check), (_, f) in found.items() if c == 1 and f}

    def at(index, column, value):
        def change(r):
            if r[0] == 1 and r[1] == index:
                r[column] = value
            return r
        return change

    assert broken(lambda r: r) == {}
    assert broken(at(10, 2, 111)) == {"event_ids_unique": 1}
    assert broken(lambda r: None if r[:2] == [1, 20] else r) == {"event_indexes_contiguous": 1}
    assert broken(at(20, 1, 21)) == {"event_indexes_contiguous": 2}
    assert broken(at(30, 3, 1000)) == {"events_in_canonical_order": 1}
    assert broken(at(49, 3, 5000)) == {"events_inside_window": 1}
    assert broken(at(5, 4, 77)) == {"event_threads_in_scope": 1}
    assert broken(at(5, 6, 77)) == {"wakers_in_scope": 1}


def test_nulls_and_missing_scope(spark):
    rows = [(1, 0, 1, 10, None, None, None), (1, 1, None, None, 5, 0, None), (None, 0, None, 3, 4, 0, None)]
    scope = spark.createDataFrame([], "capture_id int, start_ns long, end_ns long, target_tids array<bigint>")
    found = rows_of(V.event_checks(spark.createDataFrame(rows, EVENTS), scope))
    assert found[1, "events_inside_window"] == (2, 2) and found[1, "event_threads_in_scope"] == (2, 2)
    assert found[1, "event_ids_unique"] == (2, 0)
    assert rows_of(V.event_checks(spark.createDataFrame([], EVENTS), scope)) == {}


def test_difference_counts_copies(spark):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b")], "capture_id int, v string")
    b = spark.createDataFrame([(1, "a"), (1, None), (2, "c")], "capture_id int, v string")
    assert {tuple(r) for r in V.multiset_difference(a, b, ["capture_id", "v"]).collect()} == {(1, "a", 1), (2, "b", 1), (2, "c", -1)}
    assert rows_of(V.reconciled("same", a, b, ["capture_id", "v"])) == {(1, "same"): (3, 1), (2, "same"): (1, 2)}
    assert V.multiset_difference(a, a, ["capture_id", "v"]).isEmpty()


def test_conserved_without_total_and_beyond_64_bits(spark):
    big = 2**62
    parts = spark.createDataFrame([(1, big, 1), (1, big, None), (1, big, 2), (2, 1, 0)], "capture_id int, x long, y long")
    totals = spark.createDataFrame([(1, Decimal(3 * big), 3)], "capture_id int, x decimal(38,0), y long")
    assert rows_of(V.conserved("sum", parts, totals, ["x", "y"])) == {(1, "sum"): (2, 0), (2, "sum"): (2, 1)}


def test_known_and_captures_without_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z"), (1, None)], "capture_id int, ref string")
    table = spark.createDataFrame([(1, "a"), (1, "a"), (2, "z")], "capture_id int, id string")
    assert rows_of(V.known("known", rows, "ref", table, "id")) == {(1, "known"): (3, 1)}
    checks = V.evaluate(rows, [V.Check("named", F.col("ref").isNull())], captures=table)
    assert rows_of(checks) == {(1, "named"): (4, 1), (2, "named"): (0, 0)}
    assert {tuple(r) for r in V.verdicts(checks).select("capture_id", "status", F.array_join("broken", ",")).collect()} == {(1, "failed", "named"), (2, "passed", "")}


def test_sums_beyond_a_long(spark):
    """The off-CPU times of a capture's threads together exceed 64 bits."""
    big = 9 * 10**18
    threads = spark.createDataFrame([(1, big, 1), (1, big, 2), (1, big - 1, None), (2, 5, 1)], "capture_id int, x long, y long")
    totals = V.sums(threads, ["x", "y"])
    assert {r["capture_id"]: (r["x"], r["y"]) for r in totals.collect()} == {1: (3 * big - 1, 3), 2: (5, 1)}
    assert rows_of(V.conserved("sum", threads, totals, ["x", "y"])) == {(1, "sum"): (2, 0), (2, "sum"): (2, 0)}
    less = threads.where(F.col("x") != big - 1)
    assert rows_of(V.conserved("sum", less, totals, ["x", "y"])) == {(1, "sum"): (2, 1), (2, "sum"): (2, 0)}


def test_off_cpu_query_totals_beyond_a_long(spark, monkeypatch):
    """The query itself over threads whose times together exceed 64 bits; only the damage it makes is found."""
    from gristmill.plans import verify_queries as Q

    counts = "complete_count split_complete_count incomplete_count sleep_count unknown_category_count off_cpu_sample_count blocked_sample_count runnable_sample_count unknown_sample_count".split()
    times = "off_cpu_total_ns blocked_total_ns runnable_total_ns unknown_total_ns".split()
    rows = [(1, tid, *[0] * len(counts), 9 * 10**18, 9 * 10**18, 0, 0) for tid in (10, 20, 40)]  # ids that the query does not damage
    threads = spark.createDataFrame(rows, ", ".join(["capture_id int", "tid long", *[f"{n} long" for n in (*counts, *times)]]))
    monkeypatch.setattr(Q.views, "sched_events", lambda *a: None)
    monkeypatch.setattr(Q.R, "transitions", lambda rows: rows)
    monkeypatch.setattr(Q.R, "off_cpu_summary", lambda steps: threads)
    found = {r["check"]: r["failures"] for r in Q.verify_off_cpu_threads(spark, "").collect()}
    assert found["off_cpu_totals_conserved"] == 0
