"""Running values of several streams inside one, against plain windows, and the probe reader that uses them."""

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.ordered import Running, running_last, running_sum, running_within
from gristmill.sources import probe_files as P
from tests.test_probe_files import LINES, native


def test_same_as_plain_windows_over_many_spans(spark):
    x = F.col("n") * 7 % 11
    rows = spark.range(400).select(
        (F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("n"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("t"), F.col("id").alias("v")
    )
    value = F.when(F.col("t") != 1, x)
    groups = [
        ([], {"count": running_sum(F.lit(1).cast("long"), False)}),
        (["t"], {"last": running_last(value, False), "total": running_sum(value), "least": Running("min", value, False)}),
    ]
    known = spark.createDataFrame([(1, "one")], "k long, name string")
    got = running_within(rows, ["k"], "n", groups, known, span=16)
    w = lambda end, *keys: Window.partitionBy("k", *keys).orderBy("n").rowsBetween(Window.unboundedPreceding, end)
    want = rows.select(
        "*", F.count(F.lit(1)).over(w(-1)).alias("count"), F.last(value, ignorenulls=True).over(w(-1, "t")).alias("last"),
        F.coalesce(F.sum(value).over(w(0, "t")), F.lit(0)).alias("total"), F.min(value).over(w(-1, "t")).alias("least"), F.when(F.col("k") == 1, "one").alias("name"),
    )
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert got.columns == want.columns and plain(got) == plain(want)


def test_a_begin_named_twice_and_spans_of_a_file(spark):
    """Lines far apart lie in different spans; the second end that names a begin is not nested."""
    good = [dict(r) for r in native()]
    again = [dict(r) for r in native()]
    again[6] = again[6] | {"related_source_event_id": "e3", "hold_duration_ns": 15}
    again[7] = again[7] | {"related_source_event_id": "e3", "hold_duration_ns": 25}
    twice = [dict(r) for r in native()]
    twice[7] = twice[7] | {"related_source_event_id": "e4", "hold_duration_ns": 20}
    files = {"good": good, "outer first": again, "twice": twice}
    rows = [(name, 70_000 * n, json.dumps(r)) for name, records in files.items() for n, r in enumerate(records, 1)]
    found = {r.capture_id: (r.reason, r.line_no) for r in P.read_probe(spark.createDataFrame(rows, LINES)).captures.collect()}
    assert found == {"good": (None, None), "outer first": ("INVALID_EVENT_PAIR", 490_000), "twice": ("INVALID_EVENT_PAIR", 560_000)}
