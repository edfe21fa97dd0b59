"""Kernel lock waits and holds from (thread, lock) event streams.

Input rows: ``capture_id, tid, lock_id, event_index, event_id, ts_ns, event_type`` with kinds
``lock_wait``, wait ends (``acquired, timed_out, interrupted, failed, unknown``), ``released`` and
the candidate kinds ``futex_wait, futex_wake``; optional ``path_no`` or ``path`` and
``owner_evidence``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.distribution import wide_distributions
from gristmill.operators.ordered import SPAN_ROWS, count_since, cut, running, running_last
from gristmill.operators.sched import MAX_WORST, with_empty, worst

SUBJECT = ["capture_id", "tid", "lock_id"]
# fixed values: how a wait may end, and the kinds that never enter exact aggregates
WAIT_ENDS = ("acquired", "timed_out", "interrupted", "failed", "unknown")
CANDIDATES = ("futex_wait", "futex_wake", "candidate_wait")


def is_candidate() -> Column:
    return F.col("event_type").isin(*CANDIDATES)


def carried(steps: DataFrame) -> DataFrame:
    """What ``lock_steps`` of later events has to know of these: one ``carry`` row per subject."""
    return steps.where("event_type = 'end'").select(
        *SUBJECT,
        (F.col("event_index") - 1).alias("event_index"),
        F.lit("carry").alias("event_type"),
        F.struct("waits", "wait", "acquires", "acquire").alias("carry"),
    )


def lock_steps(events: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Exact lock rows and one end row per subject, with what is pending just before them.

    ``carry`` (see ``carried``) continues subjects whose earlier events were taken before.
    """
    kind = F.col("event_type")

    def carry_or(name: str, value: Column) -> Column:
        return value if carry is None else F.when(kind == "carry", F.col("carry")[name]).otherwise(value)

    path = "path" if "path" in events.columns else "path_no"
    rows = events.where(~is_candidate()).select(
        *SUBJECT, "event_index", "event_id", "ts_ns", "event_type", F.col(path).alias("path"), "owner_evidence"
    )
    rows = cut(rows if carry is None else rows.unionByName(carry, allowMissingColumns=True))  # narrow; read for the end rows and the windows
    end = rows.groupBy(*SUBJECT).agg((F.max("event_index") + 1).alias("event_index"))
    rows = rows.unionByName(end.withColumn("event_type", F.lit("end")), allowMissingColumns=True)
    row = F.struct("ts_ns", "event_id", "path", "owner_evidence")
    out = running(
        rows,
        SUBJECT,
        "event_index",
        {
            "waits": count_since(carry_or("waits", (kind == "lock_wait").cast("long")), kind.isin(*WAIT_ENDS), inclusive=False),
            "wait": running_last(carry_or("wait", F.when(kind == "lock_wait", row)), inclusive=False),
            "acquires": count_since(carry_or("acquires", (kind == "acquired").cast("long")), kind == "released", inclusive=False),
            "acquire": running_last(carry_or("acquire", F.when(kind == "acquired", row)), inclusive=False),
        },
        SPAN_ROWS,
    )
    return out if carry is None else out.where(kind != "carry").drop("carry")


def wait_intervals(steps: DataFrame) -> DataFrame:
    """Exact waits: one pending wait and the row that ends it."""
    return steps.where(F.col("event_type").isin(*WAIT_ENDS) & (F.col("waits") == 1)).select(
        *SUBJECT,
        F.col("wait.ts_ns").alias("wait_ns"),
        F.col("ts_ns").alias("wait_end_ns"),
        (F.col("ts_ns") - F.col("wait.ts_ns")).alias("duration_ns"),
        F.col("wait.event_id").alias("wait_event_id"),
        F.col("event_id").alias("wait_end_event_id"),
        F.col("event_type").alias("outcome"),
        F.col("wait.owner_evidence").alias("owner_evidence"),
        F.col("wait.path").alias("path"),
    )


def hold_intervals(steps: DataFrame) -> DataFrame:
    """Exact holds: acquire to release; a second acquire voids both."""
    closes = (F.col("event_type") == "released") & (F.col("acquires") % 2 == 1)
    return steps.where(closes).select(
        *SUBJECT,
        F.col("acquire.ts_ns").alias("acquired_ns"),
        F.col("ts_ns").alias("released_ns"),
        (F.col("ts_ns") - F.col("acquire.ts_ns")).alias("duration_ns"),
        F.col("acquire.event_id").alias("acquired_event_id"),
        F.col("event_id").alias("released_event_id"),
        F.col("acquire.path").alias("path"),
    )


def pairing_issues(steps: DataFrame) -> DataFrame:
    """Waits and holds that could not be paired, with the reason."""
    kind, waits = F.col("event_type"), F.col("waits")
    ends, odd = kind.isin(*WAIT_ENDS), F.col("acquires") % 2 == 1
    wait_reason = (
        F.when(ends & (waits > 1), "duplicate_wait")
        .when(ends & (waits == 0), "trace_start_boundary")
        .when((kind == "end") & (waits > 1), "duplicate_wait")
        .when((kind == "end") & (waits == 1), "trace_end_boundary")
    )
    hold_reason = (
        F.when((kind == "acquired") & odd, "overlapping_acquire")
        .when((kind == "released") & ~odd, "release_without_acquire")
        .when((kind == "end") & odd, "trace_end_boundary")
    )
    return (
        steps.select(
            *SUBJECT,
            "event_index",
            F.explode(
                F.array(
                    F.struct(F.lit("wait").alias("phase"), wait_reason.alias("reason")),
                    F.struct(F.lit("hold").alias("phase"), hold_reason.alias("reason")),
                )
            ).alias("issue"),
        )
        .select(*SUBJECT, "event_index", "issue.phase", "issue.reason")
        .where(F.col("reason").isNotNull())
    )


def observations(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Waits, holds and candidate rows in one long table: the input of every lock aggregate."""
    keys = [*SUBJECT, "path"]
    path = "path" if "path" in events.columns else "path_no"
    waits = wait_intervals(steps).select(*keys, F.lit("wait").alias("measure"), "duration_ns", "outcome", "owner_evidence")
    holds = hold_intervals(steps).select(*keys, F.lit("hold").alias("measure"), "duration_ns")
    marks = events.where(is_candidate()).select(
        *SUBJECT,
        F.col(path).alias("path"),
        F.when(F.col("event_type") == "futex_wake", "candidate_wake").otherwise("candidate_wait").alias("measure"),
    )
    return waits.unionByName(holds, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)


def aggregate_by(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Wait and hold distributions, outcome counts and candidate counts per ``keys``."""
    measure = F.col("measure")
    counts = observed.groupBy(*keys).agg(
        *[F.count_if((measure == "wait") & (F.col("outcome") == o)).alias(f"{o}_count") for o in WAIT_ENDS],
        F.count_if(measure == "candidate_wait").alias("candidate_wait_count"),
        F.count_if(measure == "candidate_wake").alias("candidate_wake_count"),
        F.count_if((measure == "wait") & (F.col("owner_evidence") != "unavailable")).alias("owner_observed_count"),
        F.sum(F.when(measure == "wait", F.col("duration_ns"))).alias("__wait"),
    ).drop("__wait")
    dist = wide_distributions(
        observed, keys, "measure", "duration_ns", {"wait": "wait", "hold": "hold"}
    )
    return with_empty(counts, dist, keys, ["wait", "hold"])


def waiter_threads(observed: DataFrame) -> DataFrame:
    """Distinct waiting threads per lock."""
    return (
        observed.where(F.col("measure") == "wait")
        .select("capture_id", "lock_id", "tid")
        .distinct()
        .groupBy("capture_id", "lock_id")
        .agg(F.count(F.lit(1)).alias("waiter_thread_count"))
    )


def path_occurrences(observed: DataFrame) -> DataFrame:
    """Waits and holds of each lock per path."""
    return (
        observed.where(F.col("measure").isin("wait", "hold"))
        .groupBy("capture_id", "lock_id", "path")
        .agg(
            F.count_if(F.col("measure") == "wait").alias("wait_count"),
            F.count_if(F.col("measure") == "hold").alias("hold_count"),
            F.sum(F.when(F.col("measure") == "wait", F.col("duration_ns")).otherwise(0)).alias("wait_ns"),
        )
    )


def single_kind(events: DataFrame, kind: str = "lock_kind") -> DataFrame:
    """The one kind a lock is seen with, else ``unknown``."""
    return events.groupBy("capture_id", "lock_id").agg(
        F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise("unknown").alias(kind)
    )


def worst_waits(waits: DataFrame, limit: int = MAX_WORST) -> DataFrame:
    return worst(waits, [F.desc("duration_ns"), "lock_id", "tid", F.col("wait_event_id").cast("string")], limit)


def worst_holds(holds: DataFrame, limit: int = MAX_WORST) -> DataFrame:
    return worst(holds, [F.desc("duration_ns"), "lock_id", "tid", F.col("acquired_event_id").cast("string")], limit)


def merge_contention(events: DataFrame) -> DataFrame:
    """Fold repeated contention phases into one wait.

    Input kinds: ``begin`` (flags known), ``begin_unknown`` and ``end`` (with ``result``), and
    ``epoch`` (lost records before the row).  Of each segment between ends the first known begin
    is kept; later ones are merged, unless an unknown begin came after it and poisons the segment.
    An end with result 0 is ``acquired`` only after a kept, unpoisoned begin.
    """
    kind = F.col("event_type")
    keys = [*SUBJECT, "epoch"]
    rows = cut(events.where(kind.isin("begin", "begin_unknown", "end")))
    first = running(
        rows, keys, "event_index", {"begins": count_since(kind == "begin", kind == "end", inclusive=False)}, SPAN_ROWS
    )
    first = cut(first)
    poison = (kind == "begin_unknown") & (F.col("begins") > 0)
    marked = running(
        first, keys, "event_index", {"poisons": count_since(poison, kind == "end", inclusive=False)}, SPAN_ROWS
    )
    clean = F.col("poisons") == 0
    return marked.withColumn(
        "action",
        F.when((kind == "begin") & (F.col("begins") == 0), "lock_wait")
        .when((kind == "begin") & clean, "merged")
        .when(kind == "begin", "poisoned")
        .when(kind == "begin_unknown", "unsupported")
        .otherwise(wait_outcome(F.col("result"), clean & (F.col("begins") > 0))),
    )


def wait_outcome(result: Column, audited: Column) -> Column:
    """Outcome of a wait from its return value (0, -110, -4, anything else failed)."""
    return (
        F.when((result == 0) & audited, "acquired")
        .when(result == 0, "unknown")
        .when(result == -110, "timed_out")
        .when(result == -4, "interrupted")
        .otherwise("failed")
    )
