"""Normalized runtime-lock streams: header, stacks, events as one JSON object per line.

``parse_stream`` checks each record by itself; ``accept_events`` decides which events enter the
stream.  An accepted event reserves its id and moves the clock, a rejected one does neither, so a
verdict depends on earlier verdicts: the set is settled in rounds (each round settles at least the
next undecided row), like the replay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.redact import redact_label, redact_path
from gristmill.operators.ordered import cut, join_known, running, running_max, running_sum

# fixed values: record schemas, allowed fields per kind, context kinds per runtime, bounds
CONTEXT = "struct<kind: string, target_pid: int, target_tid: bigint, runtime_context_id: string, name: string>"
HEADER = (
    "schema_version string, runtime string, runtime_version string, adapter_id string,"
    " target struct<target_pid: int, observed_target_tids: array<bigint>>,"
    " measurement_semantics string, visible_lock_kinds array<string>, owner_is_source_observed boolean,"
    " hold_time_is_source_observed boolean, declared_event_count bigint, declared_lost_event_count bigint,"
    " declared_truncated boolean"
)
STACK = (
    "schema_version string, source_stack_id string, frames array<struct<symbol: string, module: string,"
    " source_file: string, source_line: int, is_runtime: boolean, is_unknown: boolean>>"
)
EVENT = (
    "schema_version string, source_event_id string, event_kind string, timestamp_ns bigint,"
    f" execution_context {CONTEXT}, target_tid bigint, source_lock_id string, lock_kind string,"
    f" source_stack_id string, owner_execution_context {CONTEXT}, owner_target_tid bigint,"
    " wait_begin_source_event_id string, duration_ns bigint, outcome string, wait_end_source_event_id string,"
    f" acquire_source_event_id string, hold_duration_ns bigint, parked_execution_context {CONTEXT},"
    " parked_target_tid bigint, observed_count bigint, estimated_count double, cumulative_wait_ns bigint"
)
COMMON = (
    "schema_version", "record_type", "source_event_id", "event_kind", "timestamp_ns", "lock_kind",
    "source_lock_id", "source_stack_id",
)
KIND_FIELDS = {
    "wait_begin": (("owner_execution_context",), ("owner_target_tid",)),
    "wait_end": (
        ("wait_begin_source_event_id", "duration_ns", "outcome", "owner_execution_context"),
        ("wait_begin_source_event_id", "duration_ns", "outcome", "owner_target_tid"),
    ),
    "acquire": (("wait_end_source_event_id",), ()),
    "release": (("acquire_source_event_id", "hold_duration_ns"), ("acquire_source_event_id", "hold_duration_ns")),
    "park": ((), ()),
    "unpark": (("parked_execution_context",), ("parked_target_tid",)),
    "sampled_contention": (
        ("observed_count", "estimated_count", "cumulative_wait_ns"),
        ("observed_count", "estimated_count", "cumulative_wait_ns"),
    ),
}
OUTCOMES = ("acquired", "notified", "unparked", "timed_out", "interrupted", "failed", "unknown")
CONTEXT_KINDS = {
    "c_cpp": ("os_thread", "process_aggregate"),
    "java": ("os_thread", "java_platform_thread", "java_virtual_thread", "process_aggregate"),
    "python": ("os_thread", "process_aggregate"),
    "go": ("os_thread", "go_goroutine", "process_aggregate"),
    "custom": ("os_thread", "java_platform_thread", "java_virtual_thread", "go_goroutine", "process_aggregate"),
}
TOKEN = r"^[^\x00\r\n/\\]{1,128}$"
MALFORMED = (
    "INVALID_JSON", "INVALID_RECORD", "INVALID_EVENT", "SCHEMA_MISMATCH", "INVALID_CONTEXT", "UNKNOWN_STACK_ID",
    "OWNER_VISIBILITY_MISMATCH", "INVALID_EVENT_PAIR", "HOLD_VISIBILITY_MISMATCH",
)
UNSUPPORTED = ("UNSUPPORTED_RECORD", "UNSUPPORTED_EVENT", "UNDECLARED_LOCK_KIND", "SEMANTICS_MISMATCH")


@dataclass(frozen=True)
class Stream:
    """``headers`` (one row per capture), ``stacks`` (accepted and not) and raw ``events``."""

    headers: DataFrame
    stacks: DataFrame
    events: DataFrame


def context_key(context: Column) -> Column:
    """One string per execution context."""
    return F.when(
        context.isNotNull(),
        F.concat_ws(
            "|",
            context["kind"],
            context["target_pid"],
            F.coalesce(context["target_tid"].cast("string"), F.lit("")),
            F.coalesce(context["runtime_context_id"], F.lit("")),
        ),
    )


def _valid_shape(c: Column) -> Column:
    """A context has the ids its kind needs and no others."""
    plain = c["runtime_context_id"].isNull()
    return (c["target_pid"] > 0) & (
        F.when(c["kind"] == "os_thread", (c["target_tid"] > 0) & plain)
        .when(c["kind"] == "process_aggregate", c["target_tid"].isNull() & plain)
        .when(c["kind"].isin("java_virtual_thread", "go_goroutine"), ~plain & c["target_tid"].isNull())
        .when(c["kind"] == "java_platform_thread", ~plain)
        .otherwise(F.lit(False))
    )


def parse_stream(lines: DataFrame) -> Stream:
    """Parse ``capture_id, line_no, line`` rows; captures without a header on their first line give no events."""
    kind = F.get_json_object("line", "$.record_type")
    marked = cut(
        lines.withColumn("record_type", F.when(F.json_object_keys("line").isNotNull(), kind)).withColumn(
            "keys", F.json_object_keys("line")
        )
    )
    first = marked.groupBy("capture_id").agg(F.min("line_no").alias("line_no"))
    headers = (
        marked.where(F.col("record_type") == "runtime_lock_header")
        .join(first, ["capture_id", "line_no"], "left_semi")
        .select("capture_id", F.from_json("line", HEADER).alias("h"))
        .select(
            "capture_id",
            F.coalesce("h.schema_version", F.lit("1.0")).alias("schema_version"),
            "h.runtime",
            "h.adapter_id",
            F.col("h.target.target_pid").alias("target_pid"),
            F.col("h.target.observed_target_tids").alias("target_tids"),
            F.col("h.measurement_semantics").alias("semantics"),
            "h.visible_lock_kinds",
            F.col("h.owner_is_source_observed").alias("owner_observed"),
            F.col("h.hold_time_is_source_observed").alias("hold_observed"),
            "h.declared_event_count",
            F.col("h.declared_lost_event_count").alias("lost"),
            F.col("h.declared_truncated").alias("truncated"),
        )
    )
    headers = cut(headers)
    stacks = _stacks(marked, headers)
    return Stream(headers, stacks, _events(marked, headers, first))


def _stacks(marked: DataFrame, headers: DataFrame) -> DataFrame:
    """Stack records with ``reject`` and redacted frames."""
    first_event = marked.where(F.col("record_type") == "runtime_lock_event").groupBy("capture_id").agg(
        F.min("line_no").alias("first_event")
    )
    rows = (
        marked.where(F.col("record_type") == "runtime_lock_stack")
        .withColumn("s", F.from_json("line", STACK))
        .join(first_event, "capture_id", "left")
        .join(headers.select("capture_id", F.col("schema_version").alias("header_version")), "capture_id")
    )
    s = F.col("s")
    good_frames = F.forall(
        s["frames"],
        lambda f: f["symbol"].isNotNull() & f["module"].isNotNull()
        & (f["source_line"].isNull() | ((f["source_line"] > 0) & f["source_file"].isNotNull())),
    )
    valid = F.coalesce(s["source_stack_id"].rlike(TOKEN) & (F.size(s["frames"]) > 0) & good_frames, F.lit(False))
    local = (
        F.when(F.col("first_event") < F.col("line_no"), "STACK_AFTER_EVENT")
        .when(~valid, "INVALID_STACK")
        .when(~F.coalesce(s["schema_version"] == F.col("header_version"), F.lit(False)), "SCHEMA_MISMATCH")
    )
    rows = rows.select("capture_id", "line_no", "s", local.alias("local"))
    owners = (
        rows.where(F.col("local").isNull())
        .groupBy("capture_id", F.col("s.source_stack_id").alias("source_stack_id"))
        .agg(F.min("line_no").alias("owner_line"))
    )
    rows = rows.withColumn("source_stack_id", F.col("s.source_stack_id"))
    rows = join_known(rows, owners, ["capture_id", "source_stack_id"], "source_stack_id")
    frames = F.transform(
        "s.frames",
        lambda f: F.struct(
            redact_label(f["symbol"]).alias("symbol"),
            redact_path(f["module"]).alias("module"),
            F.when(f["source_file"].isNotNull(), redact_path(f["source_file"])).alias("source_file"),
            f["source_line"].alias("source_line"),
            F.coalesce(f["is_runtime"], F.lit(False)).alias("is_runtime"),
            F.coalesce(f["is_unknown"], F.lit(False)).alias("is_unknown"),
        ),
    )
    reject = (
        F.when(F.col("local").isNotNull(), F.col("local"))
        .when(F.col("owner_line") < F.col("line_no"), "DUPLICATE_STACK_ID")
    )
    return rows.select("capture_id", "line_no", "source_stack_id", frames.alias("frames"), reject.alias("reject"))


def _events(marked: DataFrame, headers: DataFrame, first: DataFrame) -> DataFrame:
    """All records that count as input events, with ``pre_reason`` and normalized columns."""
    record = F.col("record_type")
    rows = (
        marked.join(first, ["capture_id", "line_no"], "left_anti")
        .where(record.isNull() | (record != "runtime_lock_stack"))
        .withColumn("e", F.from_json("line", EVENT))
        .join(headers, "capture_id")
    )
    e = F.col("e")
    v11 = e["schema_version"] == "1.1"
    kind = e["event_kind"]

    def os_thread(tid: Column) -> Column:
        fields = [F.lit("os_thread").alias("kind"), F.col("target_pid").alias("target_pid"), tid.alias("target_tid"),
                  F.lit(None).cast("string").alias("runtime_context_id"), F.lit(None).cast("string").alias("name")]
        return F.when(tid.isNotNull(), F.struct(*fields))

    context = F.when(v11, e["execution_context"]).otherwise(os_thread(e["target_tid"]))
    owner = F.when(v11, e["owner_execution_context"]).otherwise(os_thread(e["owner_target_tid"]))
    parked = F.when(v11, e["parked_execution_context"]).otherwise(os_thread(e["parked_target_tid"]))
    rows = rows.withColumn("c", context).withColumn("o", owner).withColumn("p", parked)
    allowed = F.create_map(
        *[
            x
            for name, (new, old) in KIND_FIELDS.items()
            for version, fields, place in (("1.1", new, "execution_context"), ("1.0", old, "target_tid"))
            for x in (
                F.lit(f"{name}/{version}"),
                F.array(*[F.lit(f) for f in (*COMMON, place, *fields)]),
            )
        ]
    )
    permitted = F.try_element_at(allowed, F.concat_ws("/", kind, e["schema_version"]))
    lock_needed = kind.isin("wait_begin", "acquire", "release") | (
        (kind == "wait_end") & e["wait_begin_source_event_id"].isNotNull()
    )
    valid = (
        (F.size(F.array_distinct("keys")) == F.size("keys"))
        & (F.size(F.array_except(F.col("keys"), permitted)) == 0)
        & e["source_event_id"].rlike(TOKEN)
        & (e["timestamp_ns"] >= 0)
        & e["lock_kind"].isNotNull()
        & _valid_shape(F.col("c"))
        & (F.col("o").isNull() | _valid_shape(F.col("o")))
        & (F.col("p").isNull() | _valid_shape(F.col("p")))
        & (~lock_needed | e["source_lock_id"].isNotNull())
        & F.when(kind == "wait_end", (e["duration_ns"] >= 0) & e["outcome"].isin(*OUTCOMES))
        .when(kind == "unpark", F.col("p").isNotNull())
        .when(kind == "sampled_contention", (e["observed_count"] > 0) & (e["cumulative_wait_ns"] > 0))
        .otherwise(F.lit(True))
    )

    def outside(c: Column) -> Column:
        return c.isNotNull() & (
            (c["target_pid"] != F.col("target_pid"))
            | (c["target_tid"].isNotNull() & ~F.array_contains("target_tids", c["target_tid"]))
        )

    kinds = F.create_map(*[x for r, ks in CONTEXT_KINDS.items() for x in (F.lit(r), F.array(*[F.lit(k) for k in ks]))])

    def unfit(c: Column) -> Column:
        return c.isNotNull() & (
            ~F.array_contains(F.try_element_at(kinds, F.col("runtime")), c["kind"])
            | ((c["kind"] == "process_aggregate") & ~F.col("semantics").isin("sampled", "cumulative"))
        )

    def any_of(test) -> Column:
        return F.coalesce(test(F.col("c")) | test(F.col("o")) | test(F.col("p")), F.lit(False))

    reason = (
        F.when(F.col("keys").isNull(), "INVALID_JSON")
        .when(~F.coalesce(record == "runtime_lock_event", F.lit(False)), "UNSUPPORTED_RECORD")
        .when(~F.coalesce(kind.isin(*KIND_FIELDS), F.lit(False)), "UNSUPPORTED_EVENT")
        .when(~F.coalesce(valid, F.lit(False)), "INVALID_EVENT")
        .when(e["schema_version"] != F.col("schema_version"), "SCHEMA_MISMATCH")
        .when(any_of(outside), "OUTSIDE_TARGET_CONTEXT")
        .when(any_of(unfit), "INVALID_CONTEXT")
    )
    return rows.select(
        "capture_id",
        "line_no",
        reason.alias("pre_reason"),
        e["source_event_id"].alias("source_event_id"),
        kind.alias("event_kind"),
        e["timestamp_ns"].alias("ts_ns"),
        context_key(F.col("c")).alias("context"),
        context_key(F.col("o")).alias("owner_context"),
        context_key(F.col("p")).alias("parked_context"),
        *[
            e[n].alias(n)
            for n in (
                "source_lock_id", "lock_kind", "source_stack_id", "wait_begin_source_event_id", "duration_ns",
                "outcome", "wait_end_source_event_id", "acquire_source_event_id", "hold_duration_ns",
                "observed_count", "estimated_count", "cumulative_wait_ns",
            )
        ],
    )


def _post_reason(rows: DataFrame, headers: DataFrame, stacks: DataFrame) -> DataFrame:
    """Add the checks that follow id and order: lock kind, semantics, stack, owner, hold."""
    known = stacks.where(F.col("reject").isNull()).select(
        "capture_id", "source_stack_id", F.lit(True).alias("__known")
    )
    controls = headers.select(
        "capture_id", "semantics", "visible_lock_kinds", "owner_observed", "hold_observed"
    )
    rows = join_known(rows, known, ["capture_id", "source_stack_id"], "source_stack_id").join(controls, "capture_id")
    profile = F.col("semantics").isin("sampled", "cumulative")
    kind = F.col("event_kind")
    held = F.col("acquire_source_event_id").isNotNull() & F.col("hold_duration_ns").isNotNull()
    return (
        rows.withColumn(
            "post_reason",
            F.when(~F.array_contains("visible_lock_kinds", F.col("lock_kind")), "UNDECLARED_LOCK_KIND")
            .when((kind == "sampled_contention") != profile, "SEMANTICS_MISMATCH")
            .when(F.col("source_stack_id").isNotNull() & F.col("__known").isNull(), "UNKNOWN_STACK_ID")
            .when(F.col("owner_context").isNotNull() & ~F.col("owner_observed"), "OWNER_VISIBILITY_MISMATCH"),
        )
        .withColumn("hold_wrong", (kind == "release") & (held != F.col("hold_observed")))
        .drop("__known", "visible_lock_kinds", "owner_observed", "hold_observed")
    )


def _pair_reference() -> Column:
    kind = F.col("event_kind")
    return (
        F.when(kind == "wait_end", F.col("wait_begin_source_event_id"))
        .when(kind == "acquire", F.col("wait_end_source_event_id"))
        .when(kind == "release", F.col("acquire_source_event_id"))
    )


def accept_events(events: DataFrame, headers: DataFrame, stacks: DataFrame) -> DataFrame:
    """Add ``reason`` (null for accepted events) to the raw events.

    A row's acceptance depends on earlier rows alone, so every round settles at least one row of each capture.
    """
    rows = _post_reason(events, headers, stacks).withColumn("ref_id", _pair_reference())
    kind = F.col("event_kind")
    local_ok = F.col("pre_reason").isNull() & F.col("post_reason").isNull() & ~F.coalesce("hold_wrong", F.lit(False))
    state = cut(rows.withColumn("accepted", local_ok))
    while True:
        taken = state.where("accepted").groupBy("capture_id", "source_event_id").agg(
            F.min("line_no").alias("first_line"),
            F.min_by(
                F.struct("event_kind", "context", "source_lock_id", "lock_kind", "ts_ns", "outcome"), F.col("line_no")
            ).alias("pair"),
        )
        timed = running(
            state, ["capture_id"], "line_no",
            {"clock": running_max(F.when(F.col("accepted"), F.col("ts_ns")), inclusive=False)},
        )
        owners = taken.select("capture_id", "source_event_id", "first_line")
        pairs = taken.select(
            "capture_id",
            F.col("source_event_id").alias("ref_id"),
            F.col("first_line").alias("pair_line"),
            "pair",
        )
        joined = join_known(timed, owners, ["capture_id", "source_event_id"], "source_event_id")
        joined = join_known(joined, pairs, ["capture_id", "ref_id"], "ref_id")
        pair = F.col("pair")
        duration = F.when(kind == "wait_end", F.col("duration_ns")).when(kind == "release", F.col("hold_duration_ns"))
        wanted = F.when(kind == "wait_end", "wait_begin").when(kind == "acquire", "wait_end").otherwise("acquire")
        fits = (
            (F.col("pair_line") < F.col("line_no"))
            & (pair["event_kind"] == wanted)
            & (pair["context"] == F.col("context"))
            & pair["source_lock_id"].eqNullSafe(F.col("source_lock_id"))
            & (pair["lock_kind"] == F.col("lock_kind"))
            & (pair["ts_ns"] <= F.col("ts_ns"))
            & (duration.isNull() | (duration == F.col("ts_ns") - pair["ts_ns"]))
            & ((kind != "acquire") | (pair["outcome"] == "acquired"))
        )
        pair_ok = (
            F.when(
                (kind == "release") & (F.col("ref_id").isNull() != F.col("hold_duration_ns").isNull()), F.lit(False)
            )
            .when(~kind.isin("wait_end", "acquire", "release"), F.lit(True))
            .when(F.col("ref_id").isNull(), (kind != "wait_end") | (F.col("semantics") == "thresholded"))
            .otherwise(F.coalesce(fits, F.lit(False)))
        )
        reason = (
            F.when(F.col("pre_reason").isNotNull(), F.col("pre_reason"))
            .when(F.col("first_line") < F.col("line_no"), "DUPLICATE_EVENT_ID")
            .when(F.col("ts_ns") < F.col("clock"), "OUT_OF_ORDER_EVENT")
            .when(F.col("post_reason").isNotNull(), F.col("post_reason"))
            .when(~pair_ok, "INVALID_EVENT_PAIR")
            .when(F.col("hold_wrong"), "HOLD_VISIBILITY_MISMATCH")
        )
        judged = cut(
            joined.withColumn("reason", reason)
            .withColumn("next", F.col("reason").isNull())
            .drop("clock", "first_line", "pair_line", "pair")
        )
        if judged.where(F.col("accepted") != F.col("next")).isEmpty():
            return judged.drop("accepted", "next", "pre_reason", "post_reason", "hold_wrong", "ref_id")
        state = judged.drop("accepted", "reason").withColumnRenamed("next", "accepted")


def normalized_events(judged: DataFrame) -> DataFrame:
    """Accepted events as input of the replay, indexed 0,1,2,… per capture."""
    accepted = running(
        judged.where(F.col("reason").isNull()).withColumn("one", F.lit(1).cast("bigint")),
        ["capture_id"],
        "line_no",
        {"event_index": running_sum(F.col("one"), inclusive=False)},
    )
    kind = F.col("event_kind")
    return accepted.select(
        "capture_id",
        "event_index",
        F.col("source_event_id").alias("event_id"),
        "ts_ns",
        "context",
        "event_kind",
        "semantics",
        F.col("source_lock_id").alias("lock_id"),
        "lock_kind",
        F.col("source_stack_id").alias("stack_id"),
        "owner_context",
        F.when(kind == "wait_end", F.col("wait_begin_source_event_id")).alias("wait_begin_event_id"),
        F.when(kind == "acquire", F.col("wait_end_source_event_id")).alias("wait_end_event_id"),
        F.when(kind == "release", F.col("acquire_source_event_id")).alias("acquire_event_id"),
        "duration_ns",
        "hold_duration_ns",
        "outcome",
        "parked_context",
        "observed_count",
        "estimated_count",
        "cumulative_wait_ns",
    )


def import_counters(judged: DataFrame, stacks: DataFrame, headers: DataFrame) -> DataFrame:
    """Per capture: input and emitted events, rejects by class, stack counts, quality status."""
    reason = F.col("reason")
    events = judged.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("input_events"),
        F.count_if(reason.isNull()).alias("emitted_events"),
        F.count_if(reason.isin(*MALFORMED)).alias("malformed"),
        F.count_if(reason == "DUPLICATE_EVENT_ID").alias("duplicate"),
        F.count_if(reason == "OUT_OF_ORDER_EVENT").alias("out_of_order"),
        F.count_if(reason.isin(*UNSUPPORTED)).alias("unsupported"),
        F.count_if(reason == "OUTSIDE_TARGET_CONTEXT").alias("filtered"),
        F.count_if(reason.isNull() & F.col("owner_context").isNotNull()).alias("owner_observed_events"),
    )
    reject = F.col("reject")
    by_stack = stacks.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("input_stacks"),
        F.count_if(reject.isNull()).alias("emitted_stacks"),
        F.count_if(reject.isin("STACK_AFTER_EVENT", "INVALID_STACK", "SCHEMA_MISMATCH")).alias("malformed_stacks"),
        F.count_if(reject == "DUPLICATE_STACK_ID").alias("duplicate_stacks"),
        F.count_if(reject == "STACK_DEPTH_EXCEEDED").alias("truncated_stacks"),
    )
    rows = (
        headers.select("capture_id", "declared_event_count", F.coalesce("lost", F.lit(0)).alias("lost"), "truncated")
        .join(events, "capture_id", "left")
        .join(by_stack, "capture_id", "left")
        .join(pairing_limits(judged, headers), "capture_id", "left")
        .fillna(0)
    )
    dropped = F.lit(0).cast("bigint")
    for name in ("malformed", "duplicate", "out_of_order", "unsupported", "filtered", "malformed_stacks",
                 "duplicate_stacks", "truncated_stacks", "lost", "open_waits", "open_acquired_waits",
                 "open_holds", "uneven_parks"):
        dropped = dropped + F.col(name)
    partial = (dropped > 0) | F.coalesce("truncated", F.lit(False)) | (F.col("emitted_events") == 0)
    return rows.withColumn("quality_status", F.when(partial, "partial").otherwise("complete")).withColumn(
        "count_matches_header", F.col("declared_event_count") == F.col("input_events")
    )


def pairing_limits(judged: DataFrame, headers: DataFrame) -> DataFrame:
    """Accepted rows of exact captures whose counterpart is missing, per capture."""
    exact = headers.where(F.col("semantics") == "exact").select("capture_id", "hold_observed")
    rows = judged.where(F.col("reason").isNull()).join(exact, "capture_id")
    kind = F.col("event_kind")

    def unmatched(begin: Column, end: Column, reference: str, name: str) -> DataFrame:
        begins = rows.where(begin).select("capture_id", F.col("source_event_id").alias("id"))
        ends = rows.where(end & F.col(reference).isNotNull()).select("capture_id", F.col(reference).alias("id"))
        return begins.join(ends, ["capture_id", "id"], "left_anti").groupBy("capture_id").agg(F.count(F.lit(1)).alias(name))

    surface = rows.groupBy("capture_id").agg(
        (F.bool_or(kind == "acquire") | F.bool_or("hold_observed")).alias("acquires_seen"),
        F.bool_or("hold_observed").alias("holds_seen"),
    )
    parks = (
        rows.where(kind.isin("park", "unpark"))
        .groupBy(
            "capture_id",
            F.when(kind == "park", F.col("context")).otherwise(F.col("parked_context")).alias("who"),
            "source_lock_id",
            "lock_kind",
        )
        .agg(F.sum(F.when(kind == "park", 1).otherwise(-1)).alias("balance"))
        .groupBy("capture_id")
        .agg(F.count_if(F.col("balance") != 0).alias("uneven_parks"))
    )
    out = surface
    for part in (
        unmatched(kind == "wait_begin", kind == "wait_end", "wait_begin_source_event_id", "open_waits"),
        unmatched(
            (kind == "wait_end") & (F.col("outcome") == "acquired"), kind == "acquire",
            "wait_end_source_event_id", "open_acquired_waits",
        ),
        unmatched(kind == "acquire", kind == "release", "acquire_source_event_id", "open_holds"),
        parks,
    ):
        out = out.join(part, "capture_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "capture_id",
        F.coalesce("open_waits", zero).alias("open_waits"),
        F.when(F.col("acquires_seen"), F.coalesce("open_acquired_waits", zero)).otherwise(zero).alias("open_acquired_waits"),
        F.when(F.col("holds_seen"), F.coalesce("open_holds", zero)).otherwise(zero).alias("open_holds"),
        F.coalesce("uneven_parks", zero).alias("uneven_parks"),
    )


def conclusions(counters: DataFrame, judged: DataFrame, headers: DataFrame) -> DataFrame:
    """Allowed and forbidden conclusions of each import."""
    kinds = judged.where(F.col("reason").isNull()).groupBy("capture_id").agg(F.collect_set("event_kind").alias("kinds"))
    rows = counters.join(kinds, "capture_id", "left").join(
        headers.select("capture_id", "semantics", "owner_observed", "hold_observed", "adapter_id"), "capture_id"
    )
    seen = F.coalesce("kinds", F.array().cast("array<string>"))

    def names(*pairs: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))

    yes = F.lit(True)
    return rows.select(
        "capture_id",
        names(
            (yes, "runtime_lock_evidence_quality_and_identity"),
            (F.array_contains(seen, "wait_end"), "observed_runtime_wait_distribution"),
            (F.array_contains(seen, "release") & F.col("hold_observed"), "observed_runtime_hold_distribution"),
            (F.array_contains(seen, "sampled_contention"), "observed_runtime_contention_profile"),
        ).alias("allowed_conclusions"),
        names(
            (yes, "performance_root_cause"),
            (yes, "verified_improvement"),
            (yes, "cross_artifact_lock_identity"),
            (yes, "system_wide_or_cross_target_behavior"),
            (F.col("semantics") != "exact", "exact_contention_count"),
            (~F.col("owner_observed") | (F.col("adapter_id") == "java_jfr"), "exact_owner_relationship"),
            (~F.col("hold_observed"), "exact_hold_time"),
            (F.col("quality_status") == "partial", "unqualified_runtime_lock_conclusion"),
        ).alias("forbidden_conclusions"),
    )
