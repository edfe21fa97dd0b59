"""Stateless-looking streams: growing hotspots, latest snapshots, late and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.hotspots import KEY, with_path


def stream_hotspots(samples: DataFrame) -> DataFrame:
    """Hotspot weights that grow with the stream (update or complete mode), by the batch operator's flags.

    Rows are per (hotspot, thread), so a thread is counted once however often it comes;
    ``fold_threads`` turns the streamed table into hotspots with distinct threads.
    """
    occurrences = (
        with_path(samples)
        .select("capture_id", "thread_id", "weight", "path")
        .select("*", F.posexplode("path").alias("pos", "key"))
        .select(
            "capture_id",
            F.col("key.symbol").alias("symbol"),
            F.col("key.dso").alias("dso"),
            "thread_id",
            "weight",
            (F.col("pos") == F.size("path") - 1).alias("is_leaf"),
            (F.array_position("path", F.col("key")) == F.col("pos") + 1).alias("is_first"),
        )
    )
    return occurrences.groupBy(*KEY, "thread_id").agg(
        F.sum(F.when(F.col("is_leaf"), F.col("weight")).otherwise(0)).alias("self_weight"),
        F.sum(F.when(F.col("is_first"), F.col("weight")).otherwise(0)).alias("inclusive_weight"),
        F.count_if("is_first").alias("sample_count"),
        F.count(F.lit(1)).alias("stack_occurrence_count"),
    )


def fold_threads(streamed: DataFrame) -> DataFrame:
    """Hotspots of a table that ``stream_hotspots`` wrote, with the number of distinct threads."""
    names = ("self_weight", "inclusive_weight", "sample_count", "stack_occurrence_count")
    return streamed.groupBy(*KEY).agg(*[F.sum(n).alias(n) for n in names], F.count("thread_id").alias("thread_count"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each capture."""
    rest = [c for c in snapshots.columns if c != "capture_id"]
    latest = snapshots.groupBy("capture_id").agg(F.max_by(F.struct(*rest), F.col("ts_ns")).alias("s"))
    return latest.select("capture_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def unique_events(events: DataFrame, time_column: str, delay: str = "0 seconds") -> DataFrame:
    """Drop rows behind the watermark and repeated event ids within it.

    The engine reports dropped rows in ``numRowsDroppedByWatermark`` of the query progress.
    """
    return events.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["capture_id", "event_id"])
