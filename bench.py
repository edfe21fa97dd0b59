"""Time the headline queries; prints one JSON line.

``folded_text`` is the comparable of the published baseline: read folded text files, parse them,
and aggregate hotspots and call paths (median of three runs, files written beforehand and not
timed).  The other entries are registered queries, each run once after a short warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gristmill.operators import hotspots as H
from gristmill.plans import all_queries, views
from gristmill.sources.folded import read_folded

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = (
    "folded_parse", "hotspots", "call_paths", "symbol_variants", "profile_totals", "profile_diff", "classify",
    "sched_runtime", "off_cpu", "sched_threads", "lock_waits", "lock_by_lock", "rt_waits", "rt_by_lock",
    "stat_ipc", "bench_stats", "bench_compare", "resource_delta",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("gristmill-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.mode("overwrite").format("noop").save()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def generated_lines(spark: SparkSession) -> tuple[float, int]:
    """The published baseline's input: a million lines, 100 leaf symbols under three shared callers."""
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/generated"
    leaf = F.format_string("main;serve;step;leaf_%03d %d", F.col("id") % 100, F.col("id") % 7 + 1)
    spark.range(1_000_000).select(leaf.alias("value")).repartition(int(CPUS)).write.text(path)

    def job() -> None:
        samples = read_folded(spark, path)
        run(H.export_hotspots(H.hotspots(samples)))
        run(H.export_call_paths(H.call_paths(samples)))

    return statistics.median(timed(job) for _ in range(3)), 1_000_000


def folded_text(spark: SparkSession) -> tuple[float, int]:
    """Seconds (median of three) and records of parse, hotspots and call paths from text."""
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/folded"
    lines = views.stack_rows(spark, SF_DIR).select(F.concat_ws(" ", "stack", "weight").alias("value"))
    lines.repartition(int(CPUS)).write.text(path)

    def job() -> None:
        samples = read_folded(spark, path)
        run(H.export_hotspots(H.hotspots(samples)))
        run(H.export_call_paths(H.call_paths(samples)))

    records = spark.read.text(path).count()
    return statistics.median(timed(job) for _ in range(3)), records


def main() -> None:
    spark = session()
    spark.range(1_000_000).groupBy((F.col("id") % 100).alias("k")).count().collect()
    registered = all_queries()
    names = sys.argv[1:] or QUERIES
    seconds: dict[str, float] = {}
    rate = None
    if not sys.argv[1:] or "folded_text" in names:
        seconds["folded_text"], records = folded_text(spark)
        rate = round(records / seconds["folded_text"])
    million = None
    if not sys.argv[1:] or "folded_1m" in names:
        seconds["folded_1m"], records = generated_lines(spark)
        million = round(records / seconds["folded_1m"])
    for name in names:
        if name in registered:
            seconds[name] = timed(lambda: run(registered[name](spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "folded_records_per_sec": rate,
                "folded_1m_records_per_sec": million,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
