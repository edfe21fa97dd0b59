"""Scheduler and off-CPU intervals from per-thread event streams.

Input rows: ``capture_id, tid, event_index, event_id, ts_ns, cpu, event_type`` with kinds
``switch_in, switch_out, wakeup, migrate`` (a migrate row carries its destination in ``cpu``),
plus ``state`` (previous task state of a switch-out) and ``waker_tid`` where known.  Rows are
ordered by ``event_index`` and no task ever holds more than one span of a thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.distribution import wide_distributions
from gristmill.operators.ordered import (
    SPAN_ROWS,
    Running,
    count_since,
    cut,
    running,
    running_last,
    running_max,
    running_sum,
)

THREAD = ["capture_id", "tid"]
# fixed values: states that count as voluntary sleep, and the export bound of worst rows
SLEEP_STATES = ("interruptible_sleep", "parked", "stopped", "S")
MAX_WORST = 100


def wait_category(state: Column) -> Column:
    return F.when(state.isin(*SLEEP_STATES), "sleep").otherwise("unknown")


def expand_switches(switches: DataFrame) -> DataFrame:
    """Turn switch rows (``prev_tid``, ``next_tid``, null when foreign) into one row per thread.

    The switch-out comes before the switch-in of the same record.
    """
    side = F.explode(
        F.array(
            F.struct(F.col("prev_tid").alias("tid"), F.lit("switch_out").alias("event_type"), F.lit(0).alias("part")),
            F.struct(F.col("next_tid").alias("tid"), F.lit("switch_in").alias("event_type"), F.lit(1).alias("part")),
        )
    )
    rest = [c for c in switches.columns if c not in ("prev_tid", "next_tid", "tid", "event_type")]
    return (
        switches.select(*rest, side.alias("side"))
        .where(F.col("side.tid").isNotNull())
        .select(*rest, "side.tid", "side.event_type", (F.col("event_index") * 2 + F.col("side.part")).alias("step"))
    )


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def carried(steps: DataFrame) -> DataFrame:
    """What ``transitions`` of later events has to know of these: one ``carry`` row per thread."""
    return steps.where("event_type = 'end'").select(
        *THREAD,
        (F.col("event_index") - 1).alias("event_index"),
        F.lit("carry").alias("event_type"),
        F.struct("runs", "before", "wake", "gap", "kept", "run_cpu").alias("carry"),
    )


def transitions(events: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Switch, migrate and end-of-trace rows with the thread state just before them.

    ``runs`` counts the switch-ins since the last switch-out, ``before`` is the previous switch row,
    ``wakes`` the number of wakeups that are still pending and ``wake`` the latest of them.

    ``carry`` (see ``carried``) continues threads whose earlier events were taken before; a thread of
    ``carry`` without events only gets its end row.
    """
    kind = F.col("event_type")
    is_carry = kind == "carry"

    def carry_or(name: str, value: Column) -> Column:
        return value if carry is None else F.when(is_carry, F.col("carry")[name]).otherwise(value)
    rows = events.where(kind.isin("switch_in", "switch_out", "wakeup", "migrate")).select(
        *THREAD,
        (F.col("step") if "step" in events.columns else F.col("event_index")).alias("event_index"),
        "event_id",
        "ts_ns",
        "cpu",
        "event_type",
        _column(events, "state", "string").alias("state"),
        _column(events, "waker_tid", "bigint").alias("waker_tid"),
    )
    rows = cut(rows if carry is None else rows.unionByName(carry, allowMissingColumns=True))  # narrow; read for the end rows and the windows
    end = rows.groupBy(*THREAD).agg((F.max("event_index") + 1).alias("event_index"))
    rows = rows.unionByName(end.withColumn("event_type", F.lit("end")), allowMissingColumns=True)

    is_in, is_out, is_wake = kind == "switch_in", kind == "switch_out", kind == "wakeup"
    is_switch = is_in | is_out
    marked = running(
        rows,
        THREAD,
        "event_index",
        {
            "runs": count_since(carry_or("runs", is_in.cast("long")), is_out, inclusive=False),
            "gap": count_since(carry_or("gap", is_wake.cast("long")), is_switch, inclusive=False),
            "before": running_last(
                carry_or("before", F.when(is_switch, F.struct("event_type", "ts_ns", "event_id", "state"))), inclusive=False
            ),
            "wake": running_last(
                carry_or("wake", F.when(is_wake, F.struct("ts_ns", "event_id", "waker_tid"))), inclusive=False
            ),
        },
        SPAN_ROWS,
    ).where(kind != "wakeup")
    marked = cut(marked)
    duplicate = is_in & (F.col("runs") % 2 == 1)
    closes = is_out & (F.col("runs") % 2 == 1)
    out = running(
        marked,
        THREAD,
        "event_index",
        {
            # a duplicate switch-in leaves the wakeups before it pending
            "kept": running_last(
                carry_or("kept", F.when(is_switch, F.when(duplicate, F.col("gap")).otherwise(F.lit(0).cast("long")))),
                inclusive=False,
            ),
            "run_cpu": running_last(
                carry_or("run_cpu", F.when(closes | (kind == "migrate"), F.col("cpu"))), inclusive=False
            ),
        },
        SPAN_ROWS,
    )
    if carry is not None:
        out = out.where(~is_carry).drop("carry")
    return out.withColumn("wakes", F.col("gap") + F.coalesce("kept", F.lit(0)))


def _is_effective() -> Column:
    return (F.col("event_type") == "switch_in") & (F.col("runs") % 2 == 0)


def runtime_intervals(steps: DataFrame) -> DataFrame:
    """On-CPU runs: switch-in to switch-out; a repeated switch-in voids the run."""
    return steps.where((F.col("event_type") == "switch_out") & (F.col("runs") % 2 == 1)).select(
        *THREAD,
        F.col("before.ts_ns").alias("switch_in_ns"),
        F.col("ts_ns").alias("switch_out_ns"),
        (F.col("ts_ns") - F.col("before.ts_ns")).alias("duration_ns"),
        F.col("before.event_id").alias("switch_in_event_id"),
        F.col("event_id").alias("switch_out_event_id"),
    )


def runnable_latencies(steps: DataFrame) -> DataFrame:
    """Wakeup to switch-in, only where exactly one wakeup is pending."""
    return steps.where(_is_effective() & (F.col("wakes") == 1)).select(
        *THREAD,
        F.col("wake.ts_ns").alias("wakeup_ns"),
        F.col("ts_ns").alias("switch_in_ns"),
        (F.col("ts_ns") - F.col("wake.ts_ns")).alias("duration_ns"),
        F.col("wake.event_id").alias("wakeup_event_id"),
        F.col("event_id").alias("switch_in_event_id"),
        F.col("wake.waker_tid").alias("waker_tid"),
    )


def off_cpu_intervals(steps: DataFrame) -> DataFrame:
    """Off-CPU intervals, complete or not, split into blocked and runnable where provable."""
    kind, wakes = F.col("event_type"), F.col("wakes")
    was_off = F.coalesce(F.col("before.event_type") == "switch_out", F.lit(False))
    overlap = (kind == "switch_out") & was_off
    at_end = (kind == "end") & (was_off | (wakes > 0))
    rows = steps.where(overlap | _is_effective() | at_end)
    one = wakes == 1
    has_end = kind == "switch_in"
    start = F.when(was_off, F.col("before.ts_ns"))
    end = F.when(has_end, F.col("ts_ns"))
    wake = F.when(one, F.col("wake.ts_ns"))
    split = has_end & was_off & one
    state = F.when(was_off, F.col("before.state"))
    return rows.select(
        *THREAD,
        start.alias("switch_out_ns"),
        wake.alias("wakeup_ns"),
        end.alias("switch_in_ns"),
        (end - start).alias("total_ns"),
        F.when(split, wake - start).alias("blocked_ns"),
        F.when(split, end - wake).alias("runnable_ns"),
        F.when(split, F.lit(0).cast("long")).otherwise(end - start).alias("unknown_ns"),
        F.when(~has_end, wake - start).alias("blocked_prefix_ns"),
        F.when(has_end & ~was_off, end - wake).alias("runnable_suffix_ns"),
        state.alias("previous_state"),
        wait_category(F.coalesce(state, F.lit(""))).alias("category"),
        F.when(one, F.col("wake.waker_tid")).alias("waker_tid"),
        (has_end & was_off).alias("complete"),
        split.alias("split_complete"),
        F.when(overlap, "overlapping_switch_out")
        .when(kind == "end", "trace_end_boundary")
        .when(~was_off, "trace_start_boundary")
        .when(wakes == 0, "missing_wakeup")
        .when(wakes > 1, "duplicate_wakeup")
        .alias("incomplete_reason"),
        F.when(was_off, F.col("before.event_id")).alias("switch_out_event_id"),
        wakes.alias("wakeup_count"),
        F.when(one, F.col("wake.event_id")).alias("wakeup_event_id"),
        F.when(has_end, F.col("event_id")).alias("switch_in_event_id"),
    )


def migrated() -> Column:
    """True on rows of ``transitions`` that count as a migration."""
    return (F.col("event_type") == "migrate") | (
        _is_effective() & F.coalesce(F.col("run_cpu") != F.col("cpu"), F.lit(False))
    )


def incomplete_count() -> Column:
    """Incomplete transitions a row of ``transitions`` adds."""
    kind, wakes, odd = F.col("event_type"), F.col("wakes"), F.col("runs") % 2 == 1
    was_off = F.coalesce(F.col("before.event_type") == "switch_out", F.lit(False))

    def one(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    return (
        F.when(kind == "switch_out", one(~odd) + one(was_off))
        .when(
            kind == "switch_in",
            F.when(odd, 1).otherwise(one(wakes > 1) + one(~was_off | (wakes == 0))),
        )
        .when(kind == "end", one(odd) + one(was_off | (wakes > 0)))
        .otherwise(0)
    )


def thread_summary(steps: DataFrame) -> DataFrame:
    """Per thread: switch, migration and incomplete counts, run and runnable distributions."""
    kind = F.col("event_type")
    counts = steps.groupBy(*THREAD).agg(
        F.count_if(kind == "switch_in").alias("switch_in_count"),
        F.count_if(kind == "switch_out").alias("switch_out_count"),
        F.count_if(migrated()).alias("migration_count"),
        F.sum(incomplete_count()).alias("incomplete_transition_count"),
    )
    long = (
        runtime_intervals(steps)
        .select(*THREAD, "duration_ns", F.lit("runtime").alias("measure"))
        .unionByName(
            runnable_latencies(steps).select(*THREAD, "duration_ns", F.lit("runnable").alias("measure"))
        )
    )
    dist = wide_distributions(
        long, THREAD, "measure", "duration_ns", {"runtime": "runtime", "runnable": "runnable"}
    )
    return with_empty(counts, dist, THREAD, ["runtime", "runnable"])


def with_empty(counts: DataFrame, dist: DataFrame, keys: list[str], prefixes: list[str],
               empty_percentile: int | None = None) -> DataFrame:
    from gristmill.operators.distribution import fill_empty

    return fill_empty(counts.join(dist, keys, "left"), prefixes, empty_percentile)


def off_cpu_summary(steps: DataFrame) -> DataFrame:
    """Per thread: complete, split and incomplete counts, four distributions, category counts."""
    intervals = off_cpu_intervals(steps)
    measures = {"total_ns": "off_cpu", "blocked_ns": "blocked", "runnable_ns": "runnable"}
    # unknown time of an exactly split interval is none, not a zero sample
    unknown = F.when(F.col("complete") & ~F.col("split_complete"), F.col("unknown_ns"))
    long = intervals.select(
        *THREAD,
        F.explode(
            F.array(
                *[F.struct(F.lit(p).alias("measure"), F.col(c).alias("value")) for c, p in measures.items()],
                F.struct(F.lit("unknown").alias("measure"), unknown.alias("value")),
            )
        ).alias("m"),
    ).select(*THREAD, "m.measure", "m.value")
    names = [*measures.values(), "unknown"]
    dist = wide_distributions(long, THREAD, "measure", "value", {n: n for n in names})
    counts = intervals.groupBy(*THREAD).agg(
        F.count_if("complete").alias("complete_count"),
        F.count_if("split_complete").alias("split_complete_count"),
        F.count_if(~F.col("complete")).alias("incomplete_count"),
        F.count_if(F.col("complete") & (F.col("category") == "sleep")).alias("sleep_count"),
        F.count_if(F.col("complete") & (F.col("category") == "unknown")).alias("unknown_category_count"),
    )
    threads = steps.select(*THREAD).distinct()
    counts = threads.join(counts, THREAD, "left").fillna(0)
    return with_empty(counts, dist, THREAD, names)


def worst(rows: DataFrame, order: list[Column | str], limit: int = MAX_WORST) -> DataFrame:
    """The first ``limit`` rows of each capture in ``order``, with their rank."""
    w = Window.partitionBy("capture_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def worst_off_cpu(intervals: DataFrame, limit: int = MAX_WORST) -> DataFrame:
    none = F.lit(-1).cast("long")
    return worst(
        intervals,
        [
            F.desc(F.coalesce("total_ns", none)),
            "tid",
            F.coalesce("switch_out_ns", none),
            F.coalesce(F.col("switch_out_event_id").cast("string"), F.col("switch_in_event_id").cast("string"), F.lit("")),
        ],
        limit,
    )


def worst_runtime(intervals: DataFrame, limit: int = MAX_WORST) -> DataFrame:
    return worst(intervals, [F.desc("duration_ns"), "tid", "switch_in_ns", F.col("switch_in_event_id").cast("string")], limit)


def worst_runnable(intervals: DataFrame, limit: int = MAX_WORST) -> DataFrame:
    return worst(intervals, [F.desc("duration_ns"), "tid", "wakeup_ns", F.col("wakeup_event_id").cast("string")], limit)


def drop_late(events: DataFrame) -> DataFrame:
    """Mark rows behind the running maximum time of their capture (``late``)."""
    return running(
        events, ["capture_id"], "event_index", {"max_ts": running_max(F.col("ts_ns"), inclusive=False)}
    ).withColumn("late", F.coalesce(F.col("ts_ns") < F.col("max_ts"), F.lit(False)))


def lost_epochs(events: DataFrame) -> DataFrame:
    """Number of LOST records before each row of its capture (``epoch``)."""
    return running(
        events, ["capture_id"], "event_index", {"epoch": running_sum((F.col("event_type") == "lost").cast("long"))}
    )


def enrich_wakers(events: DataFrame) -> DataFrame:
    """Wakeup rows with the waker of the single ``waking`` row before them, else null.

    Input carries ``epoch`` (see ``lost_epochs``): a lost record clears what is pending.  A
    ``waking`` row names its waker in ``waker_tid``.
    """
    kind = F.col("event_type")
    rows = events.where(kind.isin("waking", "wakeup"))
    spec: dict[str, Running] = {
        "pending": count_since(kind == "waking", kind == "wakeup", inclusive=False),
        "last_waking": running_last(
            F.when(kind == "waking", F.struct("event_id", "waker_tid")), inclusive=False
        ),
    }
    marked = running(rows, ["capture_id", "tid", "epoch"], "event_index", spec)
    single = F.col("pending") == 1
    return marked.where(kind == "wakeup").select(
        *[c for c in marked.columns if c not in ("pending", "last_waking", "waker_tid")],
        F.when(single, F.col("last_waking.waker_tid")).alias("waker_tid"),
        F.when(single, F.col("last_waking.event_id")).alias("waking_event_id"),
        "pending",
        (F.col("pending") > 1).alias("ambiguous"),
    )


def sequence_checks(events: DataFrame) -> DataFrame:
    """Per capture: rows, index gaps, repeated ids, time steps backwards."""
    stepped = running(
        events,
        ["capture_id"],
        "event_index",
        {
            "prev_index": running_max(F.col("event_index"), inclusive=False),
            "prev_ts": running_last(F.col("ts_ns"), inclusive=False),
        },
    )
    repeats = (
        events.groupBy("capture_id", "event_id")
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .groupBy("capture_id")
        .agg(F.sum("extra").alias("duplicate_ids"))
    )
    return (
        stepped.groupBy("capture_id")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(F.col("event_index") != F.coalesce(F.col("prev_index") + 1, F.lit(0))).alias("index_gaps"),
            F.count_if(F.col("ts_ns") < F.col("prev_ts")).alias("time_reversals"),
        )
        .join(repeats, "capture_id")
    )


def dispositions(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Each event as consumed (some interval used it), unpaired, or ignored (another family)."""
    off = off_cpu_intervals(steps).where("complete")
    used = (
        runtime_intervals(steps)
        .select("capture_id", F.explode(F.array("switch_in_event_id", "switch_out_event_id")).alias("event_id"))
        .unionByName(
            runnable_latencies(steps).select(
                "capture_id", F.explode(F.array("wakeup_event_id", "switch_in_event_id")).alias("event_id")
            )
        )
        .unionByName(
            off.select(
                "capture_id",
                F.explode(
                    F.array("switch_out_event_id", F.when(F.col("split_complete"), F.col("wakeup_event_id")), "switch_in_event_id")
                ).alias("event_id"),
            ).where(F.col("event_id").isNotNull())
        )
        .distinct()
        .withColumn("used", F.lit(True))
    )
    family = F.col("event_type").isin("switch_in", "switch_out", "wakeup", "migrate")
    return events.join(used, ["capture_id", "event_id"], "left").withColumn(
        "disposition",
        F.when(~family, "ignored")
        .when(F.col("used") | (F.col("event_type") == "migrate"), "consumed")
        .otherwise("unpaired"),
    ).drop("used")
