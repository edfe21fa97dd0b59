import pytest
from pyspark.sql import functions as F

from gristmill.operators import compare as P
from gristmill.store import ResultStore
from gristmill.streaming import incremental as I
from gristmill.streaming import observed as O

SPOTS = "capture_id string, symbol string, dso string, self_percent double, inclusive_percent double, rank int"


def spots(spark, capture, n, shift=0):
    """Most rows of one capture."""
    return spark.createDataFrame([(capture, f"s{i}", f"d{i % 3}", float((i * 7 + shift) % 50), float(i % 90), i) for i in range(n)], SPOTS)


def plain(df):
    return sorted(str(tuple(r)) for r in df.select(sorted(df.columns)).collect())


def test_compared_where_they_lie(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "a"), buckets=4, prefix="t1")
    before, after = spots(spark, "b", 500), spots(spark, "c", 60, 3)
    store.write("hotspots", before.unionByName(after), ["symbol", "dso"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        diff = P.profile_diff(store.read("hotspots", "b"), store.read("hotspots", "c"), min_delta=0.0)
        plan = diff._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert plain(diff) == plain(P.profile_diff(before.drop("capture_id"), after.drop("capture_id"), min_delta=0.0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_captures_are_replaced_one_by_one(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "a"), buckets=3, prefix="t2")
    store.write("hotspots", spots(spark, "b", 20).unionByName(spots(spark, "c", 20)), ["symbol", "dso"])
    store.write("hotspots", spots(spark, "c", 5, 9).unionByName(spots(spark, "d", 4)), ["symbol", "dso"])
    want = spots(spark, "b", 20).unionByName(spots(spark, "c", 5, 9)).unionByName(spots(spark, "d", 4))
    assert plain(store.read("hotspots")) == plain(want)
    with pytest.raises(ValueError):
        store.write("hotspots", spots(spark, "c", 5), ["symbol"])


def test_columns_that_come_later_and_another_session(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "a"), buckets=3, prefix="t3")
    store.write("hotspots", spots(spark, "b", 6), ["symbol", "dso"])
    store.write("hotspots", spots(spark, "c", 6).withColumn("threads", F.col("rank") + 1).drop("inclusive_percent"), ["symbol", "dso"])
    want = plain(spots(spark, "b", 6).withColumn("threads", F.lit(None).cast("int")).unionByName(
        spots(spark, "c", 6).withColumn("threads", F.col("rank") + 1).withColumn("inclusive_percent", F.lit(None).cast("double"))
    ))
    assert plain(store.read("hotspots")) == want
    store.forget("hotspots")
    again = ResultStore(spark, str(tmp_path / "a"), buckets=99, prefix="t4")
    assert plain(again.read("hotspots")) == want
    again.write("hotspots", spots(spark, "b", 2), ["symbol", "dso"])
    assert again.read("hotspots", "b").count() == 2 and again.read("hotspots", "c").count() == 6
    with pytest.raises(ValueError):
        again.read("nothing")


def test_counters_of_a_batch_job(spark, tmp_path):
    rows = spark.range(1000).withColumn("kind", F.when(F.col("id") % 10 == 0, "malformed").otherwise("accepted"))
    seen, counts = O.watched(rows, O.counters_of("kind", ["accepted", "malformed", "lost"]))
    seen.write.parquet(str(tmp_path / "out"))
    assert counts.get == {"rows": 1000, "accepted": 900, "malformed": 100, "lost": 0}


def test_counters_of_a_stream(spark, tmp_path):
    """Malformed, repeated and late rows of every micro-batch, and their sums."""
    base = 1_700_000_000
    batches = [
        [(1, i, base + i, "accepted" if i % 4 else "malformed") for i in range(40)],
        [(1, i, base + i, "accepted") for i in range(30, 60)] + [(1, 500, base + 5000, "accepted")],  # ten rows again
        [(1, 700, base + 5002, "accepted")],  # a watermark holds for late rows one batch after it was reached
        [(1, 1000 + i, base + i, "malformed") for i in range(7)] + [(1, 600, base + 5001, "accepted")],  # seven behind the watermark
    ]
    schema = "capture_id long, event_id long, at_s long, kind string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream, none = O.watched(stream.withColumn("at", F.timestamp_seconds("at_s")), O.counters_of("kind", ["accepted", "malformed"]))
    assert none is None
    query = (
        I.unique_events(stream, "at", "100 seconds").writeStream.format("memory").queryName("counted").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
        listener = O.Progress()
        for p in query.recentProgress:
            listener.onQueryProgress(type("Event", (), {"progress": p}))
        total = listener.totals()
    finally:
        query.stop()
    assert (total["rows"], total["malformed"], total["accepted"]) == (80, 17, 63)
    assert total["duplicate"] == 10 and total["late"] == 7
    assert spark.table("counted").count() == 80 - 17
