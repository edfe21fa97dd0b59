"""Verification of stored results: every rule is one row per capture that says how often it is broken.

Rules about single rows are data (a name and a condition) and are counted in one aggregation per
relation.  Rules about several relations are reconciled as signed multisets: what is stored counts +1,
what is recomputed -1, and whatever does not cancel out is reported.  Rules about order compare each
row with the one before it over a range-partitioned sort, with the border rows carried from partition
to partition, so a capture of any length is checked in parallel.

All results have the columns ``capture_id, check, checked, failures``: how many rows (or values) a rule
looked at and how many break it.  A condition that is null counts as kept.  Captures without a row in a
relation have no rows for its checks, unless ``captures`` names them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.locks import WAIT_ENDS
from gristmill.operators.ordered import cut

REPORT = ["capture_id", "check", "checked", "failures"]
# fixed values: below this many samples percentiles are not called stable
STABLE_SAMPLES = 20


@dataclass(frozen=True)
class Check:
    """A rule about single rows; ``broken`` is true on a row that breaks it."""

    name: str
    broken: Column


def evaluate(relation: DataFrame, checks: list[Check], captures: DataFrame | None = None) -> DataFrame:
    """Count the rows of ``relation`` that break each rule, in one aggregation."""
    counted = relation.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.coalesce(c.broken, F.lit(False))).alias(f"__{i}") for i, c in enumerate(checks)],
    )
    if captures is not None:
        counted = captures.select("capture_id").distinct().join(counted, "capture_id", "left").fillna(0)
    rows = F.explode(F.array(*[F.struct(F.lit(c.name).alias("check"), F.col(f"__{i}").alias("failures")) for i, c in enumerate(checks)]))
    return counted.select("capture_id", "checked", rows.alias("r")).select("capture_id", "r.check", "checked", "r.failures")


def report(parts: Iterable[DataFrame]) -> DataFrame:
    """All check rows in one table."""
    return reduce(DataFrame.unionByName, [p.select(*REPORT) for p in parts])


def verdicts(checks: DataFrame) -> DataFrame:
    """Per capture ``passed`` or ``failed``, and the names of the broken rules."""
    broken = F.array_sort(F.collect_set(F.when(F.col("failures") > 0, F.col("check"))))
    return checks.groupBy("capture_id").agg(
        F.when(F.sum("failures") > 0, "failed").otherwise("passed").alias("status"), broken.alias("broken")
    )


# --- several relations


def multiset_difference(stored: DataFrame, computed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose number differs: ``copies`` more (or, below zero, less) in ``stored`` than in ``computed``."""
    one = F.lit(1).cast("long")
    both = stored.select(*columns, one.alias("copies")).unionByName(computed.select(*columns, (-one).alias("copies")))
    return both.groupBy(*columns).agg(F.sum("copies").alias("copies")).where(F.col("copies") != 0)


def reconciled(name: str, stored: DataFrame, computed: DataFrame, columns: list[str]) -> DataFrame:
    """Check row per capture: how many rows stand on one side alone."""
    one = F.lit(1).cast("long")
    both = stored.select(*columns, one.alias("__s"), F.lit(1).alias("__own")).unionByName(
        computed.select(*columns, (-one).alias("__s"), F.lit(0).alias("__own"))
    )
    per_row = both.groupBy(*columns).agg(F.sum("__s").alias("__d"), F.sum("__own").alias("__n"))
    return per_row.groupBy("capture_id").agg(
        F.lit(name).alias("check"), F.sum("__n").alias("checked"), F.sum(F.abs("__d")).alias("failures")
    ).select(*REPORT)


def conserved(name: str, parts: DataFrame, totals: DataFrame, measures: list[str]) -> DataFrame:
    """Check row per capture: how many of ``measures`` do not add up to their total.

    ``totals`` has one row per capture; a capture with parts and no total breaks every measure that is not 0.
    """
    def signed(df: DataFrame, sign: int) -> DataFrame:
        values = [F.struct(F.lit(m).alias("m"), (F.coalesce(F.col(m), F.lit(0)).cast("decimal(38,0)") * sign).cast("decimal(38,0)").alias("v")) for m in measures]
        return df.select("capture_id", F.explode(F.array(*values)).alias("r")).groupBy("capture_id", "r.m").agg(F.sum("r.v").alias("v"))

    off = signed(parts, 1).unionByName(signed(totals, -1)).groupBy("capture_id", "m").agg(F.sum("v").alias("v"))
    return off.groupBy("capture_id").agg(
        F.lit(name).alias("check"), F.count(F.lit(1)).alias("checked"), F.count_if(F.col("v") != 0).alias("failures")
    ).select(*REPORT)


def sums(parts: DataFrame, measures: list[str]) -> DataFrame:
    """Per capture, the sums of ``measures`` as numbers of 38 digits: the times of many threads together exceed a long."""
    return parts.groupBy("capture_id").agg(*[F.sum(F.col(m).cast("decimal(38,0)")).alias(m) for m in measures])


def unique(name: str, rows: DataFrame, key: list[str]) -> DataFrame:
    """Check row per capture: rows beyond the first of each ``key``."""
    counts = rows.groupBy("capture_id", *key).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy("capture_id").agg(
        F.lit(name).alias("check"), F.sum("__n").alias("checked"), F.sum(F.col("__n") - 1).alias("failures")
    ).select(*REPORT)


def known(name: str, rows: DataFrame, reference: str, table: DataFrame, key: str) -> DataFrame:
    """Check row per capture: rows whose ``reference`` is not null and no ``key`` of ``table``.

    References are counted before the join, so a name that most rows carry is met once.
    """
    asked = rows.where(F.col(reference).isNotNull()).groupBy("capture_id", F.col(reference).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    there = table.select("capture_id", F.col(key).alias("__key"), F.lit(True).alias("__there")).distinct()
    return asked.join(there, ["capture_id", "__key"], "left").groupBy("capture_id").agg(
        F.lit(name).alias("check"), F.sum("__n").alias("checked"), F.sum(F.when(F.col("__there"), 0).otherwise(F.col("__n"))).alias("failures")
    ).select(*REPORT)


def with_previous(rows: DataFrame, order: list[str], value: Column, name: str = "previous") -> DataFrame:
    """``rows`` with ``value`` of the row before it in its capture (null at the first), in ``order``.

    A range-partitioned sort by capture and ``order``; the last row of each partition is the border that
    the next one is compared with, so one row per partition is brought together and nothing else.
    """
    by = ["capture_id", *order]
    # asking for a number keeps the ranges as they are dealt
    placed = rows.withColumn("__value", value).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut(placed.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    here = F.struct("capture_id", "__value")
    borders = placed.groupBy("__part").agg(F.max_by(here, "__at").alias("__last"))
    borders = borders.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__border"))
    inside = F.lag(here).over(Window.partitionBy("__part").orderBy("__at"))
    met = placed.withColumn("__inside", inside).join(borders, "__part", "left")
    before = F.coalesce("__inside", "__border")
    same = before["capture_id"] == F.col("capture_id")
    return met.select(*rows.columns, F.when(same, before["__value"]).alias(name))


# --- traces


def event_checks(events: DataFrame, scope: DataFrame) -> DataFrame:
    """Ids, indexes, canonical order, time window and target scope of normalized events.

    ``events``: ``capture_id, event_index, event_id, ts_ns, tid`` and, where known, ``cpu``,
    ``source_sequence``, ``waker_tid``, ``owner_tid``.  ``scope``: one row per capture with ``start_ns``,
    ``end_ns`` and ``target_tids`` (array).  The canonical order is time, processor, source sequence, id.
    """
    key = F.struct(*[F.col(c) for c in ("ts_ns", "cpu", "source_sequence", "event_id") if c in events.columns])
    placed = with_previous(events, ["event_index", "event_id"], F.struct(F.col("event_index").alias("index"), key.alias("key")))
    rows = placed.withColumn("__key", key).join(scope.select("capture_id", "start_ns", "end_ns", "target_tids"), "capture_id", "left")
    checks = [
        Check("event_indexes_contiguous", F.col("event_index") != F.coalesce(F.col("previous.index") + 1, F.lit(0))),
        Check("events_in_canonical_order", F.col("previous.key") > F.col("__key")),
        Check("events_inside_window", ~F.coalesce(F.col("ts_ns").between(F.col("start_ns"), F.col("end_ns")), F.lit(False))),
        Check("event_threads_in_scope", ~F.coalesce(F.array_contains("target_tids", F.col("tid")), F.lit(False))),
    ]
    for column in ("waker_tid", "owner_tid"):
        if column in events.columns:
            named = F.col(column).isNotNull() & ~F.coalesce(F.array_contains("target_tids", F.col(column)), F.lit(False))
            checks.append(Check(f"{column.removesuffix('_tid')}s_in_scope", named))
    return report([evaluate(rows, checks), unique("event_ids_unique", events, ["event_id"])])


# ends and durations of each kind of interval: (start, end, duration)
_SPANS = {
    "run": ("switch_in_ns", "switch_out_ns", "duration_ns"),
    "runnable": ("wakeup_ns", "switch_in_ns", "duration_ns"),
    "wait": ("wait_ns", "wait_end_ns", "duration_ns"),
    "hold": ("acquired_ns", "released_ns", "duration_ns"),
}


def interval_checks(kind: str, intervals: DataFrame, scope: DataFrame) -> DataFrame:
    """Ends, durations and bounds of intervals of ``kind`` (``run, runnable, wait, hold, off_cpu``)."""
    rows = intervals.join(scope.select("capture_id", "start_ns", "end_ns"), "capture_id", "left")
    return evaluate(rows, _off_cpu_checks() if kind == "off_cpu" else _span_checks(kind))


def _outside(*times: str) -> Column:
    """A given time outside the window, or a time where no window is known."""
    return reduce(
        lambda a, b: a | b,
        [F.col(t).isNotNull() & ~F.coalesce(F.col(t).between(F.col("start_ns"), F.col("end_ns")), F.lit(False)) for t in times],
    )


def _span_checks(kind: str) -> list[Check]:
    start, end, duration = _SPANS[kind]
    return [
        Check(f"{kind}_ends_after_start", F.col(end) < F.col(start)),
        Check(f"{kind}_duration_exact", ~F.col(duration).eqNullSafe(F.col(end) - F.col(start))),
        Check(f"{kind}_inside_window", _outside(start, end)),
    ]


def _off_cpu_checks() -> list[Check]:
    c = F.col
    final = ["total_ns", "blocked_ns", "runnable_ns", "unknown_ns"]
    given = reduce(lambda a, b: a | b, [c(x).isNotNull() for x in final])
    ends = c("switch_out_ns").isNotNull() & c("switch_in_ns").isNotNull() & c("total_ns").isNotNull() & c("unknown_ns").isNotNull()
    parts = c("wakeup_ns").isNotNull() & c("blocked_ns").isNotNull() & c("runnable_ns").isNotNull() & c("unknown_ns").eqNullSafe(F.lit(0))
    whole = c("complete") & ends
    split = whole & c("split_complete") & parts
    zero = F.lit(0)
    return [
        Check("off_cpu_incomplete_without_duration", ~c("complete") & given),
        Check("off_cpu_incomplete_has_reason", ~c("complete") & c("incomplete_reason").isNull()),
        Check("off_cpu_incomplete_not_split", ~c("complete") & c("split_complete")),
        Check("off_cpu_complete_has_ends", c("complete") & ~ends),
        Check("off_cpu_total_exact", whole & (c("total_ns") != c("switch_in_ns") - c("switch_out_ns"))),
        Check("off_cpu_parts_conserved", whole & (c("total_ns") != F.coalesce("blocked_ns", zero) + F.coalesce("runnable_ns", zero) + c("unknown_ns"))),
        Check("off_cpu_split_has_parts", c("complete") & c("split_complete") & ~parts),
        Check("off_cpu_unsplit_without_parts", c("complete") & ~c("split_complete") & (c("blocked_ns").isNotNull() | c("runnable_ns").isNotNull())),
        Check("off_cpu_wakeup_inside", split & ~c("wakeup_ns").between(c("switch_out_ns"), c("switch_in_ns"))),
        Check("off_cpu_blocked_exact", split & (c("blocked_ns") != c("wakeup_ns") - c("switch_out_ns"))),
        Check("off_cpu_runnable_exact", split & (c("runnable_ns") != c("switch_in_ns") - c("wakeup_ns"))),
        Check("off_cpu_prefix_exact", c("blocked_prefix_ns").isNotNull() & ~c("blocked_prefix_ns").eqNullSafe(c("wakeup_ns") - c("switch_out_ns"))),
        Check("off_cpu_suffix_exact", c("runnable_suffix_ns").isNotNull() & ~c("runnable_suffix_ns").eqNullSafe(c("switch_in_ns") - c("wakeup_ns"))),
        Check("off_cpu_inside_window", _outside("switch_out_ns", "wakeup_ns", "switch_in_ns")),
    ]


def distribution_checks(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """Order of quantiles, mean and bounds of the prefixed distributions of each row.

    Where a column ``<prefix>_percentiles_stable`` exists, it must be false below 20 samples.
    """
    out = []
    for p in prefixes:
        n, total, low, high = (F.col(f"{p}_{x}") for x in ("sample_count", "total_ns", "minimum_ns", "max_ns"))
        steps = [F.coalesce(F.col(f"{p}_{x}"), F.lit(0)) for x in ("minimum_ns", "p50_ns", "p95_ns", "p99_ns", "max_ns")]
        falls = reduce(lambda a, b: a | b, [b < a for a, b in zip(steps, steps[1:])])
        values = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{p}_{x}"), F.lit(0)) != 0 for x in ("total_ns", "mean_ns", "minimum_ns", "p50_ns", "p95_ns", "p99_ns", "max_ns")])
        out += [
            Check(f"{p}_quantiles_ordered", falls),
            Check(f"{p}_empty_without_values", (n == 0) & values),
            Check(f"{p}_mean_exact", (n > 0) & (F.col(f"{p}_mean_ns") != F.floor(total.cast("decimal(38,0)") / F.when(n > 0, n).cast("decimal(20,0)")))),
            Check(f"{p}_total_within_bounds", (n > 0) & ((total < low * n) | (total > high * n))),
        ]
        if f"{p}_percentiles_stable" in rows.columns:
            out.append(Check(f"{p}_stable_only_with_samples", (n < STABLE_SAMPLES) & F.col(f"{p}_percentiles_stable")))
    return evaluate(rows, out)


def off_cpu_thread_checks(threads: DataFrame) -> DataFrame:
    """Counts and times of each thread's off-CPU summary against each other, and one row per thread."""
    c = F.col
    rules = [
        Check("off_cpu_count_matches_samples", c("complete_count") != c("off_cpu_sample_count")),
        Check("off_cpu_split_count_matches_blocked", c("split_complete_count") != c("blocked_sample_count")),
        Check("off_cpu_split_count_matches_runnable", c("split_complete_count") != c("runnable_sample_count")),
        Check("off_cpu_unknown_count_is_the_rest", c("unknown_sample_count") != c("complete_count") - c("split_complete_count")),
        Check("off_cpu_thread_time_conserved", c("off_cpu_total_ns") != c("blocked_total_ns") + c("runnable_total_ns") + c("unknown_total_ns")),
        Check("off_cpu_categories_conserved", c("sleep_count") + c("unknown_category_count") != c("complete_count")),
    ]
    return report([evaluate(threads, rules), unique("off_cpu_threads_unique", threads, ["tid"])])


def lock_checks(locks: DataFrame) -> DataFrame:
    """Counts of each lock's aggregate against each other, and one row per lock.

    ``wait_count`` and ``hold_count`` are the stored interval counts; without them the samples' own count.
    """
    count = lambda name: F.col(f"{name}_count") if f"{name}_count" in locks.columns else F.col(f"{name}_sample_count")
    outcomes = reduce(lambda a, b: a + b, [F.col(f"{o}_count") for o in WAIT_ENDS])
    rules = [
        Check("lock_wait_count_matches_samples", count("wait") != F.col("wait_sample_count")),
        Check("lock_hold_count_matches_samples", count("hold") != F.col("hold_sample_count")),
        Check("lock_outcomes_conserved", outcomes != count("wait")),
    ]
    if "lock_kind" in locks.columns:
        rules.append(Check("candidates_without_exact_intervals", (F.col("lock_kind") == "futex_candidate") & (count("wait") + count("hold") > 0)))
    return report([evaluate(locks, rules), unique("locks_unique", locks, ["lock_id"])])


def accounting_checks(events: DataFrame, ledgers: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Ledgers of event ids: they cover every event once, sample known ids, and equal the recomputed ones.

    ``events`` has a row per event; ``ledgers`` and ``recomputed`` have the columns of ``quality.ledger``.
    """
    size = events.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total_count"))
    ids = ledgers.select("capture_id", F.explode("ids").alias("id"))
    rules = [
        Check("ledger_sample_without_repeats", F.size(F.array_distinct("ids")) != F.size("ids")),
        Check("ledger_truncation_flag_exact", F.col("truncated") != (F.size("ids") < F.col("total_count"))),
    ]
    text = events.select("capture_id", F.col("event_id").cast("string").alias("event_id"))
    return report([
        conserved("ledgers_cover_events", ledgers, size, ["total_count"]),
        evaluate(ledgers, rules),
        unique("ledger_samples_disjoint", ids, ["id"]),
        known("ledger_samples_known", ids, "id", text, "event_id"),
        reconciled("ledger_counts_recomputed", ledgers, recomputed, ["capture_id", "disposition", "total_count"]),
        reconciled("ledger_digests_recomputed", ledgers, recomputed, ["capture_id", "disposition", "ids_sha256"]),
    ])


# fixed values: counters of rows that did not become events
DROPPED = ("malformed", "duplicate", "out_of_order", "unsupported", "truncated", "foreign")


def quality_checks(quality: DataFrame, analysis: DataFrame | None = None) -> DataFrame:
    """Conversion counters of each capture: conserved, not contradicted by the status, not changed later.

    ``quality``: one row per capture with ``input, emitted, expanded, merged, lost, unpaired``, the counters of
    ``DROPPED`` and ``quality_status``.  ``analysis``: the same counters as an analysis carries them on.
    """
    c = F.col
    dropped = reduce(lambda a, b: a + b, [c(n) for n in DROPPED])
    degraded = (c("input") == 0) | (c("emitted") == 0) | (c("lost") > 0) | (c("unpaired") > 0) | (dropped > 0)
    parts = [
        evaluate(
            quality,
            [
                Check("inputs_conserved", c("input") + c("expanded") != c("emitted") + c("merged") + dropped),
                Check("unpaired_within_emitted", c("unpaired") > c("emitted")),
                Check("status_follows_counters", (c("quality_status") == "partial") != degraded),
            ],
        )
    ]
    if analysis is not None:
        owned = ["input", "emitted", "expanded", "merged", "lost", *DROPPED]
        later = analysis.select("capture_id", c("unpaired").alias("__unpaired"), c("quality_status").alias("__status"), *[c(n).alias(f"__{n}") for n in owned])
        met = quality.join(later, "capture_id", "left")
        changed = reduce(lambda a, b: a | b, [~c(n).eqNullSafe(c(f"__{n}")) for n in owned])
        parts.append(
            evaluate(
                met,
                [
                    Check("analysis_keeps_counters", changed),
                    Check("analysis_keeps_unpaired", c("__unpaired") < c("unpaired")),
                    Check("analysis_unpaired_within_emitted", c("__unpaired") > c("__emitted")),
                    Check("analysis_status_not_better", degraded & (c("__status") != "partial")),
                ],
            )
        )
    return report(parts)


# --- runtime locks


def runtime_evidence_checks(events: DataFrame, stacks: DataFrame, contexts: DataFrame, quality: DataFrame, source: DataFrame) -> DataFrame:
    """Runtime-lock evidence against its counters, tables of stacks and contexts, and what its source can see.

    ``events``: as read by ``runtime_ndjson`` (``capture_id, event_index, event_id, ts_ns, context, event_kind,
    semantics, lock_id, lock_kind, stack_id, owner_context, parked_context, hold_duration_ns``).
    ``stacks``: ``capture_id, stack_id, depth``.  ``contexts``: ``capture_id, context, kind, tid``.
    ``quality``: one row per capture with ``input_events, emitted_events, filtered, malformed, duplicate,
    out_of_order, unsupported, truncated, lost, input_stacks, emitted_stacks, malformed_stacks, duplicate_stacks,
    truncated_stacks, owner_observed_events, quality_status``, the four ``<semantics>_events`` and the arrays
    ``allowed_conclusions, forbidden_conclusions``.  ``source``: ``capture_id, semantics, owner_observed,
    hold_observed, max_stack_depth``.
    """
    c = F.col
    about = source.select(
        "capture_id", c("semantics").alias("__semantics"), c("owner_observed").alias("__owner"), c("hold_observed").alias("__hold"), c("max_stack_depth").alias("__depth")
    )
    placed = with_previous(events, ["event_index", "event_id"], F.struct(c("event_index").alias("index"), "ts_ns"))
    event_rules = [
        Check("event_indexes_contiguous", c("event_index") != F.coalesce(c("previous.index") + 1, F.lit(0))),
        Check("events_in_time_order", c("previous.ts_ns") > c("ts_ns")),
        Check("semantics_not_mixed", ~c("semantics").eqNullSafe(c("__semantics"))),
        Check("owners_visible_to_source", c("owner_context").isNotNull() & ~c("__owner")),
        Check("holds_visible_to_source", (c("event_kind") == "release") & c("hold_duration_ns").isNotNull() & ~c("__hold")),
    ]
    seen = events.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("emitted_events"),
        F.count("owner_context").alias("owner_observed_events"),
        *[F.count_if(c("semantics") == s).alias(f"{s}_events") for s in SEMANTICS],
    )
    named = events.select("capture_id", F.explode(F.array_compact(F.array("context", "owner_context", "parked_context"))).alias("context"))
    kinds = events.where(c("lock_id").isNotNull()).groupBy("capture_id", "lock_id").agg((F.min("lock_kind") != F.max("lock_kind")).alias("mixed"))
    ended = reduce(lambda a, b: a + b, [c(n) for n in ("emitted_events", "filtered", "malformed", "duplicate", "out_of_order", "unsupported", "truncated")])
    stacked = reduce(lambda a, b: a + b, [c(n) for n in ("emitted_stacks", "malformed_stacks", "duplicate_stacks", "truncated_stacks")])
    bad = ("malformed", "duplicate", "out_of_order", "unsupported", "lost", "truncated", "malformed_stacks", "duplicate_stacks", "truncated_stacks")
    degraded = reduce(lambda a, b: a | b, [c(n) > 0 for n in bad])
    quality_rules = [
        Check("input_events_conserved", c("input_events") != ended),
        Check("input_stacks_conserved", c("input_stacks") != stacked),
        Check("status_follows_counters", (c("quality_status") == "partial") != degraded),
        Check("gates_disjoint", F.arrays_overlap("allowed_conclusions", "forbidden_conclusions")),
    ]
    no_tid, virtual = c("tid").isNull(), c("kind").isin("java_virtual_thread", "go_goroutine")
    context_rules = [
        Check("os_threads_have_a_tid", (c("kind") == "os_thread") & no_tid),
        Check("aggregates_have_no_tid", (c("kind") == "process_aggregate") & ~no_tid),
        Check("virtual_threads_have_no_tid", virtual & ~no_tid),
    ]
    return report([
        evaluate(placed.join(about, "capture_id", "left"), event_rules),
        unique("event_ids_unique", events, ["event_id"]),
        unique("stack_ids_unique", stacks, ["stack_id"]),
        unique("context_ids_unique", contexts, ["context"]),
        known("stacks_known", events, "stack_id", stacks, "stack_id"),
        known("contexts_known", named, "context", contexts, "context"),
        known("contexts_all_used", contexts, "context", named, "context"),
        evaluate(stacks.join(about, "capture_id", "left"), [Check("stack_depth_within_limit", c("depth") > c("__depth"))]),
        evaluate(contexts, context_rules),
        evaluate(kinds, [Check("lock_kinds_do_not_change", c("mixed"))]),
        evaluate(quality, quality_rules),
        conserved("emitted_events_counted", seen, quality, ["emitted_events"]),
        conserved("owner_observations_conserved", seen, quality, ["owner_observed_events"]),
        conserved("semantics_conserved", seen, quality, [f"{s}_events" for s in SEMANTICS]),
        conserved("emitted_stacks_counted", stacks.groupBy("capture_id").agg(F.count(F.lit(1)).alias("emitted_stacks")), quality, ["emitted_stacks"]),
    ])


# fixed values: what a source can measure
SEMANTICS = ("exact", "thresholded", "sampled", "cumulative")
