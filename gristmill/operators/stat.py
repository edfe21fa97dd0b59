"""Derived counter metrics and checks of a counter event set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.symbols import canonical_perf_event

# fixed values: event classes of counter rows
HARDWARE_EVENTS = (
    "cycles", "instructions", "cache-references", "cache-misses", "branches", "branch-misses",
)
SOFTWARE_EVENTS = ("task-clock", "context-switches", "cpu-migrations", "page-faults")
IPC_EVENT = "instructions-per-cycle"
IPC_UNIT = "instructions/cycle"


def ipc(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Instructions per cycle where both were measured and cycles are positive.

    The last measured row of an event wins, by ``line_no``.
    """
    keys = keys or ["capture_id"]
    measured = metrics.where((F.col("status") == "measured") & F.col("value").isNotNull())
    order = F.col("line_no") if "line_no" in metrics.columns else F.lit(0)

    def last(event: str):
        return F.max_by("value", F.when(F.col("event") == event, order)).alias(f"__{event}")

    return (
        measured.where(F.col("event").isin("cycles", "instructions"))
        .groupBy(*keys)
        .agg(last("cycles"), last("instructions"))
        .where(F.col("__instructions").isNotNull() & (F.col("__cycles") > 0))
        .select(
            *keys,
            F.lit(IPC_EVENT).alias("event"),
            (F.col("__instructions") / F.col("__cycles")).alias("value"),
            F.lit(IPC_UNIT).alias("unit"),
            F.lit(True).alias("derived"),
            F.lit("derived").alias("status"),
        )
    )


def with_ipc(metrics: DataFrame) -> DataFrame:
    return metrics.unionByName(ipc(metrics), allowMissingColumns=True)


def event_set_checks(metrics: DataFrame, requested: DataFrame) -> DataFrame:
    """Per capture: repeated events, canonical set equality with ``requested``, usable hardware row.

    ``requested`` holds (capture_id, event).  Both sides are reduced to (capture, event) first.
    """
    base = metrics.where(~F.col("derived"))
    canonical = canonical_perf_event(F.col("event"))
    counts = (
        base.groupBy("capture_id", "event")
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .groupBy("capture_id")
        .agg(F.sum("extra").alias("duplicate_events"))
    )
    probe = canonical.isin("cycles", "instructions")
    usable = F.coalesce(
        canonical.isin(*HARDWARE_EVENTS)
        & (F.col("status") == "measured")
        & F.when(probe, F.col("value") > 0).otherwise(F.col("value") >= 0),
        F.lit(False),
    )
    seen = base.groupBy("capture_id", canonical.alias("event")).agg(
        F.bool_or(usable).alias("usable"), F.bool_or(probe).alias("probe")
    )
    asked = requested.select("capture_id", canonical.alias("event")).distinct().withColumn("asked", F.lit(True))
    hardware = F.col("event").isin(*HARDWARE_EVENTS)
    sets = (
        seen.withColumn("got", F.lit(True))
        .join(asked, ["capture_id", "event"], "full_outer")
        .groupBy("capture_id")
        .agg(
            F.count_if(F.col("got").isNull() | F.col("asked").isNull()).alias("set_differences"),
            F.bool_or(F.coalesce(hardware & F.col("asked"), F.lit(False))).alias("has_hardware_event"),
            F.bool_or(F.coalesce(F.col("asked") & F.col("event").isin("cycles", "instructions"), F.lit(False))).alias("__probe"),
            F.bool_or(F.coalesce(F.col("usable") & F.col("probe") & F.col("asked"), F.lit(False))).alias("__probe_usable"),
            F.bool_or(F.coalesce(F.col("usable") & F.col("asked"), F.lit(False))).alias("__any_usable"),
            F.bool_and(F.coalesce(F.col("event").isin(*SOFTWARE_EVENTS) | F.col("asked").isNull(), F.lit(True))).alias(
                "only_software_events"
            ),
        )
    )
    return sets.join(counts, "capture_id", "left").select(
        "capture_id",
        F.coalesce("duplicate_events", F.lit(0)).alias("duplicate_events"),
        (F.col("set_differences") == 0).alias("event_set_matches"),
        "has_hardware_event",
        F.when(F.col("__probe"), F.col("__probe_usable")).otherwise(F.col("__any_usable")).alias("has_usable_hardware_metric"),
        "only_software_events",
    )
