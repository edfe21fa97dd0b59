"""Runtime-lock streams: conservative replay, projections, conservation.

Input rows (one capture = one stream with one measurement semantics):
``capture_id, event_index, event_id, ts_ns, context, event_kind, semantics, lock_id, lock_kind,
stack_id, owner_context, wait_begin_event_id, wait_end_event_id, acquire_event_id, duration_ns,
hold_duration_ns, outcome, parked_context, observed_count, estimated_count, cumulative_wait_ns``.

Whether a row that names another row takes effect depends on what earlier rows did to that other
row.  The replay therefore starts from "every well-formed reference holds", derives the state of
all subjects with running values, re-judges the references and repeats until nothing changes.
Each round settles at least the next disputed row of every subject, so it ends; streams whose
references are consistent need one round and one check.  No subject is ever held by one task.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.distribution import wide_distributions
from gristmill.operators.ordered import (
    SPAN_ROWS,
    Running,
    count_since,
    cut,
    cut_texts,
    join_known,
    running,
    running_last,
    running_max,
    running_sum,
)
from gristmill.operators.sched import with_empty

SUBJECT = ["capture_id", "context", "lock_key", "lock_kind"]
# fixed values: names of the event kinds, the lock kind that nests, the bound of listed stacks
WAITS = ("wait_begin", "wait_end", "acquire", "release")
RECURSIVE = "recursive_mutex"
TOP_STACKS = 10
NO_LOCK, NO_STACK = "~aggregate", "~unknown"

_COMMON = ["capture_id", "context", "lock_id", "lock_kind", "stack_id"]
_OPTIONAL = {
    "lock_id": "string", "stack_id": "string", "owner_context": "string", "wait_begin_event_id": "string",
    "wait_end_event_id": "string", "acquire_event_id": "string", "duration_ns": "bigint",
    "hold_duration_ns": "bigint", "outcome": "string", "parked_context": "string",
    "observed_count": "bigint", "estimated_count": "double", "cumulative_wait_ns": "bigint",
}


class Replay:
    """Results of one replay; each table is planned when it is first asked for."""

    def __init__(self, base: DataFrame, effects: DataFrame, nested: bool, span: int | None) -> None:
        self._base, self._effects, self._nested, self._span = base, effects, nested, span

    @cached_property
    def _parks(self) -> DataFrame:
        return _parks(self._base, self._span)

    @cached_property
    def waits(self) -> DataFrame:
        return _waits(self._effects, self._parks)

    @cached_property
    def holds(self) -> DataFrame:
        return _holds(self._effects)

    @cached_property
    def profiles(self) -> DataFrame:
        return self._base.where(F.col("event_kind") == "sampled_contention").select(
            *_COMMON, "semantics", "observed_count", "estimated_count", "cumulative_wait_ns", "event_id"
        )

    @cached_property
    def issues(self) -> DataFrame:
        """What could not be paired: phase, reason and the one or two rows concerned."""
        return _issues(self._base, self._effects, self._parks, self._nested, self._span)

    @cached_property
    def dispositions(self) -> DataFrame:
        """Each event as consumed, unpaired or ignored."""
        return _dispositions(self._base, self._effects, self.waits, self.profiles, self.issues)


def _with_references(events: DataFrame) -> DataFrame:
    """Every event with the row it refers to (by id, anywhere in its capture)."""
    rows = events.select(
        "capture_id",
        F.col("event_index").cast("bigint").alias("event_index"),
        F.col("event_id").cast("string").alias("event_id"),
        "ts_ns",
        "context",
        "event_kind",
        "semantics",
        "lock_kind",
        *[
            (F.col(name).cast(kind) if name in events.columns else F.lit(None).cast(kind)).alias(name)
            for name, kind in _OPTIONAL.items()
        ],
    ).withColumn("lock_key", F.coalesce("lock_id", F.lit("")))
    kind = F.col("event_kind")
    rows = rows.withColumn(
        "ref_id",
        F.when(kind == "wait_end", F.col("wait_begin_event_id"))
        .when(kind == "acquire", F.col("wait_end_event_id"))
        .when(kind == "release", F.col("acquire_event_id")),
    )
    rows = cut_texts(rows)  # read as the rows that name, those that do not, and those that are named
    targets = rows.where(kind.isin("wait_begin", "wait_end", "acquire")).select(
        "capture_id",
        F.col("event_id").alias("ref_id"),
        F.struct(
            "event_index", "event_kind", "ts_ns", "context", "lock_key", "lock_kind", "semantics",
            "outcome", "stack_id", "owner_context",
        ).alias("ref"),
    )
    return join_known(rows, targets, ["capture_id", "ref_id"], "ref_id")


def _static_ok() -> Column:
    """The named row exists and is of the kind that may be named."""
    kind, ref = F.col("event_kind"), F.col("ref")
    return F.coalesce(
        F.when(kind == "wait_end", ref["event_kind"] == "wait_begin")
        .when(kind == "acquire", (ref["event_kind"] == "wait_end") & (ref["outcome"] == "acquired"))
        .when(kind == "release", ref["event_kind"] == "acquire"),
        F.lit(False),
    )


def _same_subject() -> Column:
    ref = F.col("ref")
    same = (
        (ref["context"] == F.col("context"))
        & (ref["lock_key"] == F.col("lock_key"))
        & (ref["lock_kind"] == F.col("lock_kind"))
        & (ref["semantics"] == F.col("semantics"))
    )
    late = (F.col("event_kind") == "acquire") & (ref["ts_ns"] > F.col("ts_ns"))
    return F.coalesce(same & ~late, F.lit(False))


def _foreign_clears(rows: DataFrame) -> DataFrame:
    """Ends that name a row of another subject drop what is open there."""
    kind = F.col("event_kind")
    return rows.where((F.col("verdict") == "mismatch") & kind.isin("wait_end", "release")).select(
        "capture_id",
        F.col("ref.context").alias("context"),
        F.col("ref.lock_key").alias("lock_key"),
        F.col("ref.lock_kind").alias("lock_kind"),
        "event_index",
        F.when(kind == "wait_end", "clear_wait").otherwise("clear_hold").alias("event_kind"),
    )


def _state(rows: DataFrame, nested: bool, span: int | None) -> DataFrame:
    """Wait/acquire/release rows with what is pending on their subject just before them."""
    kind, verdict = F.col("event_kind"), F.col("verdict")
    holds_ref = F.col("ref_id").isNull() | (verdict == "ok")
    ops = rows.unionByName(_foreign_clears(rows), allowMissingColumns=True)
    clears_wait = (kind.isin("wait_end", "acquire") & holds_ref) | (kind == "clear_wait")
    pushes = (kind == "acquire") & holds_ref
    clears_hold = ((kind == "release") & holds_ref) | (kind == "clear_hold")
    row = F.struct("event_id", "ts_ns", "stack_id", "owner_context")
    state = running(
        ops,
        SUBJECT,
        "event_index",
        {
            "begins": count_since(kind == "wait_begin", clears_wait, inclusive=False),
            "begin": running_last(F.when(kind == "wait_begin", row), inclusive=False),
            "acquires": count_since(pushes, clears_hold, inclusive=False),
            "acquire": running_last(F.when(pushes, row), inclusive=False),
            "last_clear": running_max(
                F.when((kind == "clear_hold") | (verdict == "non_lifo"), F.col("event_index")), inclusive=False
            ),
        },
        span,
    )
    plain = F.col("lock_kind") != RECURSIVE
    pending = F.when(F.col("begins") % 2 == 1, F.col("begin"))
    flat = state.withColumn("pending", pending).withColumn(
        "active", F.when(plain & (F.col("acquires") % 2 == 1), F.col("acquire"))
    )
    if nested:
        flat = _nested_state(cut(flat), span)
    return flat.where(~kind.isin("clear_wait", "clear_hold"))


def _nested_state(state: DataFrame, span: int | None) -> DataFrame:
    """Replace ``active`` of recursive locks by the innermost open acquire.

    Depth is the running sum of acquires minus releases, never below zero and starting anew after
    a clear; the acquire a release meets is the last one at its depth.
    """
    kind, verdict = F.col("event_kind"), F.col("verdict")
    is_nested = F.col("lock_kind") == RECURSIVE
    holds_ref = F.col("ref_id").isNull() | (verdict == "ok")
    hold_rows = kind.isin("acquire", "release", "clear_hold")
    rows = state.where(is_nested & hold_rows)
    clears = (kind == "clear_hold") | F.coalesce(verdict == "non_lifo", F.lit(False))

    def settle(df: DataFrame) -> DataFrame:
        return cut(df)

    rows = settle(
        running(
            rows, SUBJECT, "event_index", {"part": running_sum(clears.cast("bigint"), inclusive=False)}, span
        )
    )
    keys = [*SUBJECT, "part"]
    pushes = (kind == "acquire") & holds_ref
    change = (
        F.when(pushes, 1).when((kind == "release") & holds_ref, -1).otherwise(0)
    ).cast("bigint")
    rows = running(rows, keys, "event_index", {"level_before": running_sum(change, inclusive=False)}, span)
    rows = settle(rows.withColumn("level_after", F.col("level_before") + change))
    rows = running(
        rows, keys, "event_index", {"low": Running("min", F.col("level_after"), inclusive=False)}, span
    )
    zero = F.lit(0).cast("bigint")
    depth = F.col("level_before") - F.least(zero, F.coalesce("low", zero))
    rows = settle(rows.withColumn("depth", F.when(pushes, depth + 1).otherwise(depth)))
    row = F.struct("event_id", "ts_ns", "stack_id", "owner_context")
    rows = running(
        rows,
        [*keys, "depth"],
        "event_index",
        {"top": running_last(F.when(pushes, row), inclusive=False)},
        span,
    )
    top = F.when((kind == "release") & (F.col("depth") > 0), F.col("top"))
    rows = rows.withColumn("active", top).select(state.columns)
    return state.where(~(is_nested & hold_rows)).unionByName(rows)


def _effects(state: DataFrame) -> DataFrame:
    """Per row: issue, record, link and release it causes (null where it causes none)."""
    kind, verdict = F.col("event_kind"), F.col("verdict")
    named = F.col("ref_id").isNotNull()
    effective = ~named | (verdict == "ok")
    ref_row = F.struct(
        F.col("ref_id").alias("event_id"),
        F.col("ref.ts_ns").alias("ts_ns"),
        F.col("ref.stack_id").alias("stack_id"),
        F.col("ref.owner_context").alias("owner_context"),
    )
    start = F.when(kind == "acquire", F.col("pending")).when(
        kind == "wait_end", F.when(named, ref_row).otherwise(F.col("pending"))
    )
    start = F.when(effective, start)
    acquire = F.when((kind == "release") & effective, F.when(named, ref_row).otherwise(F.col("active")))
    state = state.withColumn("start", start).withColumn("held", acquire)
    exact_time = F.when(
        kind == "wait_end", F.col("ts_ns") - F.col("start.ts_ns") == F.col("duration_ns")
    ).otherwise(F.lit(True)) & (F.col("ts_ns") >= F.col("start.ts_ns"))
    exact_hold = (F.col("ts_ns") - F.col("held.ts_ns") == F.col("hold_duration_ns")) & (
        F.col("ts_ns") >= F.col("held.ts_ns")
    )
    none = F.lit(None).cast("string")

    def issue(phase: str, reason: str, subject: Column, related: Column = none) -> Column:
        return F.struct(
            F.lit(phase).alias("phase"),
            F.lit(reason).alias("reason"),
            subject.alias("subject_id"),
            related.alias("related_id"),
        )

    me, ref = F.col("event_id"), F.col("ref_id")
    thresholded = F.col("semantics") == "thresholded"
    wait_issue = (
        F.when(
            (kind == "wait_begin") & F.col("pending").isNotNull(),
            issue("wait", "duplicate_wait_begin", F.col("pending.event_id"), me),
        )
        .when(kind.isin("wait_end", "acquire") & (verdict == "unknown"), issue("wait", "unknown_wait_begin", me))
        .when((kind == "wait_end") & (verdict == "reused"), issue("wait", "reused_wait_begin", me, ref))
        .when((kind == "acquire") & (verdict == "reused"), issue("wait", "reused_wait_end", me, ref))
        .when(kind.isin("wait_end", "acquire") & (verdict == "mismatch"), issue("wait", "wait_identity_mismatch", me, ref))
        .when(
            (kind == "wait_end") & effective & F.col("start").isNull() & ~thresholded,
            issue("wait", "wait_end_without_begin", me),
        )
        .when(
            (kind == "wait_end") & F.col("start").isNotNull() & ~exact_time,
            issue("wait", "wait_duration_mismatch", me, F.col("start.event_id")),
        )
    )
    hold_issue = (
        F.when(
            (kind == "acquire") & effective & F.col("active").isNotNull() & (F.col("lock_kind") != RECURSIVE),
            issue("hold", "duplicate_acquire", F.col("active.event_id"), me),
        )
        .when((kind == "release") & (verdict == "unknown"), issue("hold", "unknown_acquire", me))
        .when((kind == "release") & verdict.isin("reused", "not_active"), issue("hold", "reused_acquire", me, ref))
        .when((kind == "release") & (verdict == "mismatch"), issue("hold", "hold_identity_mismatch", me, ref))
        .when((kind == "release") & (verdict == "non_lifo"), issue("hold", "non_lifo_release", me, ref))
        .when((kind == "release") & effective & F.col("held").isNull(), issue("hold", "release_without_acquire", me))
        .when(
            (kind == "release") & F.col("held").isNotNull() & F.col("hold_duration_ns").isNotNull() & ~exact_hold,
            issue("hold", "hold_duration_mismatch", me, F.col("held.event_id")),
        )
    )
    recorded = kind.isin("wait_end", "acquire") & F.col("start").isNotNull() & exact_time
    return (
        state.withColumn("wait_issue", wait_issue)
        .withColumn("hold_issue", hold_issue)
        .withColumn("recorded", F.coalesce(recorded, F.lit(False)))
        .withColumn("linked", F.coalesce((kind == "acquire") & (verdict == "ok"), F.lit(False)))
        .withColumn("released", F.coalesce((kind == "release") & F.col("held").isNotNull(), F.lit(False)))
        .withColumn(
            "held_exactly",
            F.coalesce(
                F.col("held").isNotNull() & F.col("hold_duration_ns").isNotNull() & exact_hold, F.lit(False)
            ),
        )
    )


def _marks(effects: DataFrame) -> DataFrame:
    """When each named row was first paired, linked, released or found invalid."""

    def mark(condition: Column, what: str, event_id: Column) -> Column:
        return F.when(condition, F.struct(F.lit(what).alias("what"), event_id.alias("id")))

    entries = F.array_compact(
        F.array(
            mark(F.col("recorded"), "paired", F.col("start.event_id")),
            mark(F.col("linked"), "linked", F.col("ref_id")),
            mark(F.col("released"), "released", F.col("held.event_id")),
            *[
                mark(F.col(f"{i}.{side}").isNotNull(), "invalid", F.col(f"{i}.{side}"))
                for i in ("wait_issue", "hold_issue")
                for side in ("subject_id", "related_id")
            ],
        )
    )
    long = effects.select("capture_id", "event_index", F.explode(entries).alias("m"))
    return long.groupBy("capture_id", F.col("m.id").alias("ref_id")).agg(
        *[
            F.min(F.when(F.col("m.what") == what, F.col("event_index"))).alias(f"{what}_at")
            for what in ("paired", "linked", "released", "invalid")
        ]
    )


def _judge(effects: DataFrame) -> DataFrame:
    """``effects`` with the verdict each reference deserves under the state just derived."""
    kind, index = F.col("event_kind"), F.col("event_index")

    def before(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_at") < index, F.lit(False))

    used = (
        F.when(kind == "wait_end", before("paired"))
        .when(kind == "acquire", before("linked"))
        .otherwise(before("released"))
    )
    is_top = F.coalesce(F.col("active.event_id") == F.col("ref_id"), F.lit(False))
    inside = (F.col("ref.event_index") < index) & (
        F.col("ref.event_index") > F.coalesce("last_clear", F.lit(-1).cast("bigint"))
    )
    verdict = (
        F.when(F.col("ref_id").isNull(), F.lit(None).cast("string"))
        .when(~_static_ok(), "unknown")
        .when(used | before("invalid"), "reused")
        .when(~_same_subject(), "mismatch")
        .when((kind == "release") & ~is_top & (F.col("lock_kind") == RECURSIVE) & inside, "non_lifo")
        .when((kind == "release") & ~is_top, "not_active")
        .otherwise("ok")
    )
    marked = join_known(effects, _marks(effects), ["capture_id", "ref_id"], "ref_id")
    return marked.withColumn("next_verdict", verdict)


def replay(events: DataFrame) -> Replay:
    """Pair waits, holds and parks; report what could not be paired and why.

    Captures do not depend on each other, so each round only takes the captures that changed.  A verdict
    depends on earlier rows alone, so every round settles at least the first open row of each capture.
    """
    base = cut(_with_references(events))
    kind = F.col("event_kind")
    span = SPAN_ROWS
    pending = base.where(kind.isin(*WAITS)).withColumn(
        "verdict",
        F.when(F.col("ref_id").isNull(), F.lit(None).cast("string"))
        .when(~_static_ok(), "unknown")
        .when(~_same_subject(), "mismatch")
        .otherwise("ok"),
    )
    nested = not base.where((F.col("lock_kind") == RECURSIVE) & kind.isin("acquire", "release")).isEmpty()
    references = not base.where(F.col("ref_id").isNotNull()).isEmpty()
    settled: list[DataFrame] = []
    while True:
        effects = cut(_effects(_state(pending, nested, span)))
        if not references:
            settled.append(effects)
            break
        judged = cut(_judge(effects).select("capture_id", "event_id", "verdict", "next_verdict"))
        changed = judged.where(~F.col("verdict").eqNullSafe(F.col("next_verdict")))
        if changed.isEmpty():
            settled.append(effects)
            break
        captures = changed.select("capture_id").distinct()
        settled.append(effects.join(captures, "capture_id", "left_anti"))
        verdicts = judged.join(captures, "capture_id", "left_semi").select(
            "capture_id", "event_id", F.col("next_verdict").alias("verdict")
        )
        pending = cut(pending.drop("verdict").join(verdicts, ["capture_id", "event_id"]))
    effects = settled[0]
    for part in settled[1:]:
        effects = effects.unionByName(part)
    return Replay(base, effects, nested, span)


def _waits(effects: DataFrame, parks: DataFrame) -> DataFrame:
    kind = F.col("event_kind")
    owner = F.col("start.owner_context").isNotNull() | F.col("owner_context").isNotNull()
    paired = effects.where("recorded").select(
        *_COMMON[:4],
        F.coalesce("stack_id", "start.stack_id").alias("stack_id"),
        "semantics",
        F.when(kind == "acquire", F.col("ts_ns") - F.col("start.ts_ns")).otherwise(F.col("duration_ns")).alias("duration_ns"),
        F.when(kind == "acquire", "acquired").otherwise(F.col("outcome")).alias("outcome"),
        owner.alias("owner_observed"),
        F.col("start.event_id").alias("begin_event_id"),
        F.col("event_id").alias("end_event_id"),
    )
    lone = effects.where(
        (kind == "wait_end") & F.col("start").isNull() & (F.col("semantics") == "thresholded")
        & (F.col("ref_id").isNull() | (F.col("verdict") == "ok"))
    ).select(
        *_COMMON,
        "semantics",
        "duration_ns",
        "outcome",
        F.col("owner_context").isNotNull().alias("owner_observed"),
        F.lit(None).cast("string").alias("begin_event_id"),
        F.col("event_id").alias("end_event_id"),
    )
    unparked = parks.where((kind == "unpark") & F.col("parked").isNotNull()).select(
        "capture_id",
        F.col("parked_context").alias("context"),
        "lock_id",
        "lock_kind",
        F.coalesce("stack_id", "parked.stack_id").alias("stack_id"),
        "semantics",
        (F.col("ts_ns") - F.col("parked.ts_ns")).alias("duration_ns"),
        F.lit("unparked").alias("outcome"),
        (F.col("parked.owner_context").isNotNull() | F.col("owner_context").isNotNull()).alias("owner_observed"),
        F.col("parked.event_id").alias("begin_event_id"),
        F.col("event_id").alias("end_event_id"),
    )
    return paired.unionByName(lone).unionByName(unparked)


def _holds(effects: DataFrame) -> DataFrame:
    return effects.where(F.col("held_exactly") & (F.col("semantics") == "exact")).select(
        *_COMMON[:4],
        F.coalesce("stack_id", "held.stack_id").alias("stack_id"),
        F.col("hold_duration_ns").alias("duration_ns"),
        F.col("held.event_id").alias("acquire_event_id"),
        F.col("event_id").alias("release_event_id"),
    )


def _parks(base: DataFrame, span: int | None) -> DataFrame:
    """Park and unpark rows (and one end row per subject) with the park that is pending."""
    kind = F.col("event_kind")
    keys = ["capture_id", "park_context", "lock_key", "lock_kind"]
    rows = base.where(
        (kind == "park") | ((kind == "unpark") & F.col("parked_context").isNotNull())
    ).withColumn("park_context", F.when(kind == "park", F.col("context")).otherwise(F.col("parked_context")))
    end = rows.groupBy(*keys).agg(
        (F.max("event_index") + 1).alias("event_index"), F.max("lock_id").alias("lock_id")
    )
    rows = rows.unionByName(end.withColumn("event_kind", F.lit("end")), allowMissingColumns=True)
    state = running(
        rows,
        keys,
        "event_index",
        {
            "parks": count_since(kind == "park", kind == "unpark", inclusive=False),
            "park": running_last(
                F.when(kind == "park", F.struct("event_id", "ts_ns", "stack_id", "owner_context")), inclusive=False
            ),
        },
        span,
    )
    return state.withColumn("parked", F.when(F.col("parks") % 2 == 1, F.col("park")))


def _open_at_end(effects: DataFrame, span: int | None) -> DataFrame:
    """Waits and holds still open after the last row of their subject.

    Recursive locks may have many open acquires; those are the acquires no release met.
    """
    kind = F.col("event_kind")
    rows = effects.select(
        *SUBJECT, "lock_id", "event_index", "event_id", "event_kind", "ts_ns", "stack_id", "owner_context",
        "ref_id", "ref", "verdict",
    )
    # rows of other subjects that clear this one may come after its own last row
    ends = rows.select(*SUBJECT, "lock_id", "event_index").unionByName(_foreign_clears(rows).drop("event_kind"), allowMissingColumns=True)
    end = ends.groupBy(*SUBJECT).agg(
        (F.max("event_index") + 1).alias("event_index"), F.max("lock_id").alias("lock_id")
    )
    probe = rows.unionByName(end.withColumn("event_kind", F.lit("end")), allowMissingColumns=True)
    state = _state(probe, False, span).where(kind == "end")
    waits = state.where(F.col("pending").isNotNull()).select(
        *SUBJECT, "lock_id", F.lit("wait").alias("phase"), F.col("pending.event_id").alias("event_id")
    )
    holds = state.where(F.col("active").isNotNull()).select(
        *SUBJECT, "lock_id", F.lit("hold").alias("phase"), F.col("active.event_id").alias("event_id")
    )
    return waits.unionByName(holds)


def _issues(
    base: DataFrame, effects: DataFrame, parks: DataFrame, nested: bool, span: int | None
) -> DataFrame:
    columns = ["capture_id", "phase", "reason", "event_index", "subject_id", "related_id", "context", "lock_id", "lock_kind"]
    kind = F.col("event_kind")
    found = effects.select(
        "capture_id",
        "event_index",
        "context",
        "lock_id",
        "lock_kind",
        F.explode(F.array_compact(F.array("wait_issue", "hold_issue"))).alias("i"),
    ).select("i.*", "capture_id", "event_index", "context", "lock_id", "lock_kind")
    end_index = F.lit(None).cast("bigint").alias("event_index")
    none = F.lit(None).cast("string")

    def boundary(open_rows: DataFrame) -> DataFrame:
        return open_rows.select(
            "capture_id",
            "phase",
            F.lit("trace_end_boundary").alias("reason"),
            end_index,
            F.col("event_id").alias("subject_id"),
            none.alias("related_id"),
            "context",
            "lock_id",
            "lock_kind",
        )

    at_end = boundary(_open_at_end(effects, span))
    if nested:
        at_end = at_end.unionByName(boundary(_open_nested(effects)))
    reason = (
        F.when((kind == "park") & F.col("parked").isNotNull(), "duplicate_wait_begin")
        .when((kind == "unpark") & F.col("parked").isNull(), "unpark_without_park")
        .when((kind == "end") & F.col("parked").isNotNull(), "trace_end_boundary")
    )
    first = F.when(kind == "unpark", F.col("event_id")).otherwise(F.col("parked.event_id"))
    park_issues = (
        parks.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(
            "capture_id",
            F.lit("park").alias("phase"),
            "reason",
            F.when(kind != "end", F.col("event_index")).alias("event_index"),
            first.alias("subject_id"),
            F.when(kind == "park", F.col("event_id")).alias("related_id"),
            F.when(kind == "unpark", F.col("context")).otherwise(F.col("park_context")).alias("context"),
            "lock_id",
            "lock_kind",
        )
    )
    nobody = base.where((kind == "unpark") & F.col("parked_context").isNull()).select(
        "capture_id",
        F.lit("park").alias("phase"),
        F.lit("unpark_without_park").alias("reason"),
        "event_index",
        F.col("event_id").alias("subject_id"),
        none.alias("related_id"),
        "context",
        "lock_id",
        "lock_kind",
    )
    out = found.select(columns)
    for part in (at_end, park_issues, nobody):
        out = out.unionByName(part.select(columns))
    return out


def _open_nested(effects: DataFrame) -> DataFrame:
    """Acquires of recursive locks that no release met and no clear dropped."""
    kind = F.col("event_kind")
    nested = effects.where(F.col("lock_kind") == RECURSIVE)
    opened = nested.where((kind == "acquire") & (F.col("ref_id").isNull() | (F.col("verdict") == "ok")))
    met = nested.where("released").select("capture_id", F.col("held.event_id").alias("event_id"))
    cleared = nested.where(F.col("verdict") == "non_lifo").select(
        *SUBJECT, F.col("event_index").alias("clear_index")
    )
    foreign = effects.where((F.col("verdict") == "mismatch") & (kind == "release")).select(
        "capture_id",
        F.col("ref.context").alias("context"),
        F.col("ref.lock_key").alias("lock_key"),
        F.col("ref.lock_kind").alias("lock_kind"),
        F.col("event_index").alias("clear_index"),
    )
    last_clear = cleared.unionByName(foreign).groupBy(*SUBJECT).agg(F.max("clear_index").alias("clear_index"))
    return (
        opened.join(met, ["capture_id", "event_id"], "left_anti")
        .join(last_clear, SUBJECT, "left")
        .where(F.col("clear_index").isNull() | (F.col("event_index") > F.col("clear_index")))
        .select(*SUBJECT, "lock_id", F.lit("hold").alias("phase"), "event_id")
    )


def _dispositions(base: DataFrame, effects: DataFrame, waits: DataFrame, profiles: DataFrame, issues: DataFrame) -> DataFrame:
    def ids(df: DataFrame, *columns: str) -> DataFrame:
        return df.select("capture_id", F.explode(F.array_compact(F.array(*columns))).alias("event_id"))

    used = (
        ids(waits, "begin_event_id", "end_event_id")
        .unionByName(ids(profiles, "event_id"))
        .unionByName(ids(effects.where("linked"), "event_id", "ref_id"))
        .unionByName(
            ids(
                effects.where(F.col("released") & (F.col("hold_duration_ns").isNull() | F.col("held_exactly"))),
                "event_id",
                "held.event_id",
            )
        )
        .distinct()
        .withColumn("used", F.lit(True))
    )
    invalid = ids(issues, "subject_id", "related_id").distinct().withColumn("invalid", F.lit(True))
    return (
        base.select("capture_id", "event_index", "event_id", "event_kind")
        .join(used, ["capture_id", "event_id"], "left")
        .join(invalid, ["capture_id", "event_id"], "left")
        .select(
            "capture_id",
            "event_index",
            "event_id",
            "event_kind",
            F.when(F.col("used"), "consumed").when(F.col("invalid"), "unpaired").otherwise("ignored").alias("disposition"),
        )
    )


def observations(result: Replay) -> DataFrame:
    """Waits, holds and profiles in one long table: the input of all five projections.

    Holds count under outcome ``acquired``, profiles under ``unknown``.
    """
    waits = result.waits.select(
        *_COMMON,
        F.when(F.col("semantics") == "exact", "exact_wait").otherwise("thresholded_wait").alias("measure"),
        "duration_ns",
        F.col("duration_ns").alias("wait_ns"),
        "outcome",
        F.col("owner_observed").cast("int").alias("owner_observed"),
        F.lit(0).cast("bigint").alias("observed_count"),
    )
    holds = result.holds.select(
        *_COMMON,
        F.lit("exact_hold").alias("measure"),
        "duration_ns",
        F.lit(0).cast("bigint").alias("wait_ns"),
        F.lit("acquired").alias("outcome"),
        F.lit(0).alias("owner_observed"),
        F.lit(0).cast("bigint").alias("observed_count"),
    )
    profiles = result.profiles.select(
        *_COMMON,
        F.when(F.col("semantics") == "sampled", "sampled").otherwise("cumulative").alias("measure"),
        F.lit(None).cast("bigint").alias("duration_ns"),
        F.col("cumulative_wait_ns").alias("wait_ns"),
        F.lit("unknown").alias("outcome"),
        F.lit(0).alias("owner_observed"),
        "observed_count",
    )
    return waits.unionByName(holds).unionByName(profiles)


# fixed values: keys of the five projections
PROJECTIONS = {
    "lock": ["lock_id", "lock_kind"],
    "execution_context": ["context"],
    "call_path": ["stack_id"],
    "wait_outcome": ["outcome"],
    "lock_kind": ["lock_kind"],
}
_PREFIXES = ["exact_wait", "thresholded_wait", "exact_hold"]


def metrics_by(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Distributions and totals per (capture, ``keys``); hidden keys form one group."""
    hidden = {"lock_id": NO_LOCK, "stack_id": NO_STACK}
    filled = observed
    for key in keys:
        if key in hidden:
            filled = filled.withColumn(key, F.coalesce(key, F.lit(hidden[key])))
    group = ["capture_id", *keys]
    measure = F.col("measure")
    counts = filled.groupBy(*group).agg(
        F.coalesce(F.sum(F.when(measure == "sampled", F.col("observed_count"))), F.lit(0)).alias("sampled_observation_count"),
        F.coalesce(F.sum(F.when(measure == "cumulative", F.col("observed_count"))), F.lit(0)).alias("cumulative_observation_count"),
        F.sum("wait_ns").alias("observed_or_estimated_wait_ns"),
        F.sum("owner_observed").alias("owner_observed_count"),
    )
    dist = wide_distributions(
        filled.where(measure.isin(*_PREFIXES)), group, "measure", "duration_ns", {p: p for p in _PREFIXES}, 0
    )
    return with_empty(counts, dist, group, _PREFIXES, 0).withColumn(
        "observation_count",
        F.col("exact_wait_sample_count")
        + F.col("thresholded_wait_sample_count")
        + F.col("sampled_observation_count")
        + F.col("cumulative_observation_count"),
    )


def _distinct_count(observed: DataFrame, group: list[str], values: list[str], name: str) -> DataFrame:
    return (
        observed.select(*group, *values).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias(name))
    )


def projection(observed: DataFrame, name: str) -> DataFrame:
    """One of the five projections with its cardinalities.

    A lock count is null as soon as one contributing row hides its lock; waiter contexts of a lock
    come from waits and profiles, not from holds.
    """
    keys = PROJECTIONS[name]
    group = ["capture_id", *keys]
    filled = observed
    for key, value in (("lock_id", NO_LOCK), ("stack_id", NO_STACK)):
        filled = filled.withColumn(key, F.coalesce(key, F.lit(value)))
    rows = metrics_by(observed, keys)
    if name == "lock":
        waiting = filled.where(F.col("measure") != "exact_hold")
        waiters = _distinct_count(waiting, group, ["context"], "waiter_context_count")
        return rows.join(waiters, group, "left").fillna({"waiter_context_count": 0})
    locks = (
        filled.select(*group, F.col("lock_id").alias("__lock"), F.col("lock_kind").alias("__kind"))
        .distinct()
        .groupBy(*group)
        .agg(F.when(~F.bool_or(F.col("__lock") == NO_LOCK), F.count(F.lit(1))).alias("lock_count"))
    )
    rows = rows.join(locks, group)
    if name == "execution_context":
        return rows
    return rows.join(_distinct_count(filled, group, ["context"], "execution_context_count"), group)


def rank_projection(rows: DataFrame, name: str) -> DataFrame:
    """Add ``rank``: most wait, then most hold, then most observations, then identity."""
    identity = [F.col(k) for k in PROJECTIONS[name]]
    order = Window.partitionBy("capture_id").orderBy(
        F.desc("observed_or_estimated_wait_ns"), F.desc("exact_hold_total_ns"), F.desc("observation_count"), *identity
    )
    return rows.withColumn("rank", F.row_number().over(order))


# fixed values: sums that a bounded export must account for
COVERAGE_SUMS = {
    "exact_wait_count": "exact_wait_sample_count",
    "exact_wait_ns": "exact_wait_total_ns",
    "thresholded_wait_count": "thresholded_wait_sample_count",
    "thresholded_wait_ns": "thresholded_wait_total_ns",
    "sampled_observation_count": "sampled_observation_count",
    "cumulative_observation_count": "cumulative_observation_count",
    "observed_or_estimated_wait_ns": "observed_or_estimated_wait_ns",
    "observation_count": "observation_count",
    "wait_ns": "observed_or_estimated_wait_ns",
    "hold_count": "exact_hold_sample_count",
    "hold_ns": "exact_hold_total_ns",
    "owner_observed_count": "owner_observed_count",
}


def export_projection(rows: DataFrame, name: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each capture; only they are ranked over a bounded set."""
    return rank_projection(rows, name).where(F.col("rank") <= limit)


def coverage(rows: DataFrame, name: str, limit: int) -> DataFrame:
    """What an export of ``limit`` rows leaves out, one row per capture: totals minus exported."""
    kept = export_projection(rows, name, limit)

    def sums(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy("capture_id").agg(
            F.count(F.lit(1)).alias(f"{prefix}_rows"),
            *[F.sum(c).alias(f"{prefix}_{n}") for n, c in COVERAGE_SUMS.items()],
        )

    both = sums(rows, "all").join(sums(kept, "kept"), "capture_id")
    return both.select(
        "capture_id",
        F.col("all_rows").alias("total_row_count"),
        F.col("kept_rows").alias("exported_row_count"),
        (F.col("all_rows") - F.col("kept_rows")).alias("omitted_row_count"),
        *[(F.col(f"all_{n}") - F.col(f"kept_{n}")).alias(f"omitted_{n}") for n in COVERAGE_SUMS],
    )


def top_stacks(observed: DataFrame, limit: int = TOP_STACKS) -> DataFrame:
    """The ``limit`` heaviest stacks of each lock by wait plus hold time; ties by stack id."""
    key = ["capture_id", "lock_id", "lock_kind"]
    weight = F.when(F.col("measure") == "exact_hold", F.col("duration_ns")).otherwise(F.col("wait_ns"))
    summed = (
        observed.where(F.col("stack_id").isNotNull())
        .withColumn("lock_id", F.coalesce("lock_id", F.lit(NO_LOCK)))
        .groupBy(*key, "stack_id")
        .agg(F.sum(weight).alias("weight_ns"))
    )
    order = Window.partitionBy(*key).orderBy(F.desc("weight_ns"), "stack_id")
    return summed.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def totals(observed: DataFrame) -> DataFrame:
    """One row per capture."""
    return metrics_by(observed, [])


def conservation(observed: DataFrame, limit: int) -> DataFrame:
    """For each projection: exported plus omitted equals the totals (one row per check)."""
    ledger = {
        "observation_count": "observation_count",
        "wait_ns": "observed_or_estimated_wait_ns",
        "hold_count": "exact_hold_sample_count",
        "hold_ns": "exact_hold_total_ns",
    }
    expected = totals(observed).select("capture_id", *[F.col(c).alias(f"want_{n}") for n, c in ledger.items()])
    out = None
    for name in PROJECTIONS:
        rows = cut(projection(observed, name))
        kept = export_projection(rows, name, limit).groupBy("capture_id").agg(
            *[F.sum(c).alias(f"kept_{n}") for n, c in ledger.items()]
        )
        checked = kept.join(coverage(rows, name, limit), "capture_id").join(expected, "capture_id")
        passed = F.lit(True)
        for n in ledger:
            passed = passed & (F.col(f"kept_{n}") + F.col(f"omitted_{n}") == F.col(f"want_{n}"))
        part = checked.select("capture_id", F.lit(name).alias("projection"), passed.alias("passed"))
        out = part if out is None else out.unionByName(part)
    return out


def first_seen_ordinals(events: DataFrame, column: str) -> DataFrame:
    """Dense ordinals 0,1,2,… of the distinct ids of each capture in first-seen order."""
    seen = (
        events.where(F.col(column).isNotNull())
        .groupBy("capture_id", column)
        .agg(F.min("event_index").alias("event_index"))
    )
    counted = running(
        seen.withColumn("one", F.lit(1).cast("bigint")),
        ["capture_id"],
        "event_index",
        {"ordinal": running_sum(F.col("one"), inclusive=False)},
    )
    return counted.select("capture_id", column, "ordinal")


def lifo_pairs(events: DataFrame, subject: list[str]) -> DataFrame:
    """Check that ends name the innermost open begin of their subject.

    Input: ``event_index, event_id, step`` (+1 begin, -1 end), ``ref_id``.  Adds ``partner_id`` and
    ``violation``.
    """
    step = F.col("step").cast("bigint")
    rows = cut(running(events, subject, "event_index", {"depth": running_sum(step)}))
    leveled = rows.withColumn("level", F.when(F.col("step") > 0, F.col("depth")).otherwise(F.col("depth") + 1))
    paired = running(
        leveled,
        [*subject, "level"],
        "event_index",
        {"partner_id": running_last(F.when(F.col("step") > 0, F.col("event_id")), inclusive=False)},
    )
    is_end = F.col("step") < 0
    return paired.withColumn(
        "violation",
        is_end & ((F.col("depth") < 0) | ~F.col("partner_id").eqNullSafe(F.col("ref_id"))),
    ).withColumn("partner_id", F.when(is_end, F.col("partner_id")))


def diagnosis_summary(total_row: DataFrame, observed: DataFrame, keep: int = 32) -> DataFrame:
    """One row per capture: counts and the heaviest locks, contexts and stacks (``keep`` each)."""
    out = total_row.select(
        "capture_id",
        "exact_wait_sample_count",
        "exact_wait_total_ns",
        "thresholded_wait_sample_count",
        "thresholded_wait_total_ns",
        "sampled_observation_count",
        "cumulative_observation_count",
    )
    for name, key in (("lock", "lock_id"), ("execution_context", "context"), ("call_path", "stack_id")):
        ranked = export_projection(metrics_by(observed, PROJECTIONS[name]), name, keep)
        named = F.when(~F.col(key).isin(NO_LOCK, NO_STACK), F.struct("rank", F.col(key).alias("id")))
        top = ranked.groupBy("capture_id").agg(
            F.transform(F.sort_array(F.collect_list(named)), lambda r: r["id"]).alias(f"top_{key}s")
        )
        out = out.join(top, "capture_id", "left")
    return out
