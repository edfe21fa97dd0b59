"""Kernel trace records as one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import trace_codes as C
from gristmill.operators import sched as S
from gristmill.operators.ordered import running, running_max

# fixed values: common fields, fields of each kind, futex operations, form of lock ids
COMMON = ("schema_version", "sequence", "timestamp_ns", "cpu", "kind", "target_tid")
KIND_FIELDS = {
    "sched_switch_out": ("related_target_tid", "related_scope", "previous_state"),
    "sched_switch_in": ("related_target_tid", "related_scope"),
    "sched_switch_both": ("related_target_tid", "related_scope", "previous_state"),
    "sched_waking": ("related_target_tid", "related_scope", "target_cpu"),
    "sched_wakeup": ("target_cpu",),
    "sched_wakeup_new": ("target_cpu",),
    "sched_migrate": ("origin_cpu", "destination_cpu"),
    "lock_wait": ("lock_id", "lock_flags"),
    "lock_wait_ended": ("lock_id", "wait_result"),
    "futex_wait": ("lock_id", "futex_operation"),
    "futex_wake": ("lock_id", "futex_operation"),
}
SCHEMA = (
    "schema_version string, sequence bigint, timestamp_ns bigint, cpu int, kind string, target_tid bigint,"
    " related_target_tid bigint, related_scope string, previous_state bigint, target_cpu int, origin_cpu int,"
    " destination_cpu int, lock_id string, lock_flags bigint, wait_result bigint, futex_operation string"
)
LOCK_ID = r"^lock-[0-9a-f]{20}$"
FUTEX_WAIT_NAMES = ("wait", "wait_bitset", "wait_requeue_pi")
FUTEX_WAKE_NAMES = ("wake", "wake_bitset", "requeue")


def parse_kernel_trace(lines: DataFrame, targets: DataFrame, mode: str) -> DataFrame:
    """Typed records and their ``disposition``: accepted, malformed or out_of_order.

    Input lines are numbered from 1 without gaps; ``sequence`` must be the line number minus one.
    ``targets``: ``capture_id, target_tids``.
    """
    keys = F.json_object_keys("line")
    rows = (
        lines.withColumn("keys", keys)
        .withColumn("r", F.from_json("line", SCHEMA, {"mode": "PERMISSIVE"}))
        .join(targets.select("capture_id", "target_tids"), "capture_id", "left")
    )
    r = F.col("r")
    allowed = F.create_map(
        *[x for kind, fields in KIND_FIELDS.items() for x in (F.lit(kind), F.array(*[F.lit(f) for f in (*COMMON, *fields)]))]
    )
    tids = F.coalesce("target_tids", F.array().cast("array<bigint>"))

    def needs(*names: str) -> Column:
        good = F.lit(True)
        for name in names:
            good = good & r[name].isNotNull()
        return good

    kind = r["kind"]
    related_ok = r["related_target_tid"].isNull() | F.array_contains(tids, r["related_target_tid"])
    scope_ok = r["related_scope"].isin("target", "external_redacted")
    typed = (
        F.when(kind.isin("sched_switch_out", "sched_switch_both"), scope_ok & related_ok & (r["previous_state"] >= 0)
               & ((kind != "sched_switch_both") | r["related_target_tid"].isNotNull()))
        .when(kind == "sched_switch_in", scope_ok & related_ok)
        .when(kind == "sched_waking", related_ok & F.when(r["related_target_tid"].isNotNull(), r["related_scope"] == "target")
              .otherwise(r["related_scope"].isNull() | (r["related_scope"] == "external_redacted")))
        .when(kind == "sched_migrate", (r["origin_cpu"] >= 0) & (r["destination_cpu"] >= 0))
        .when(kind == "lock_wait", r["lock_id"].rlike(LOCK_ID))
        .when(kind == "lock_wait_ended", r["lock_id"].rlike(LOCK_ID) & needs("wait_result"))
        .when(kind == "futex_wait", r["lock_id"].rlike(LOCK_ID) & r["futex_operation"].isin(*FUTEX_WAIT_NAMES))
        .when(kind == "futex_wake", r["lock_id"].rlike(LOCK_ID) & r["futex_operation"].isin(*FUTEX_WAKE_NAMES))
        .otherwise(F.lit(True))
    )
    in_mode = (
        F.startswith(kind, F.lit("sched_")) if mode in ("sched", "off_cpu") else ~F.startswith(kind, F.lit("sched_"))
    )
    common = (
        F.col("keys").isNotNull()
        & (F.size(F.array_distinct("keys")) == F.size("keys"))
        & (F.size(F.array_except(F.array(*[F.lit(c) for c in COMMON]), F.col("keys"))) == 0)
        & (r["schema_version"] == "1.0")
        & (F.size(F.array_except(F.col("keys"), F.try_element_at(allowed, kind))) == 0)
        & (r["sequence"] == F.col("line_no") - 1)
        & (r["timestamp_ns"] >= 0)
        & (r["cpu"] >= 0)
        & F.array_contains(tids, r["target_tid"])
    )
    rows = rows.withColumn("common", F.coalesce(common, F.lit(False))).withColumn(
        "typed", F.coalesce(typed & in_mode, F.lit(False))
    )
    rows = running(
        rows,
        ["capture_id"],
        "line_no",
        {"max_ts": running_max(F.when(F.col("common"), r["timestamp_ns"]), inclusive=False)},
    )
    disposition = (
        F.when(~F.col("common"), "malformed")
        .when(F.col("r.timestamp_ns") < F.col("max_ts"), "out_of_order")
        .when(~F.col("typed"), "malformed")
        .otherwise("accepted")
    )
    return rows.select("capture_id", "line_no", "r.*", disposition.alias("disposition"))


def kernel_events(parsed: DataFrame) -> DataFrame:
    """Accepted scheduler records as per-thread events with wakers; lock records as lock events."""
    kind = F.col("kind")
    rows = parsed.where(F.col("disposition") == "accepted").select(
        "capture_id",
        F.col("line_no").alias("event_index"),
        C.event_id(F.col("sequence"), F.col("timestamp_ns"), kind).alias("event_id"),
        F.col("timestamp_ns").alias("ts_ns"),
        "cpu",
        "kind",
        F.col("target_tid").alias("tid"),
        "related_target_tid",
        "previous_state",
        "destination_cpu",
        "lock_id",
        "wait_result",
        "futex_operation",
        F.lit(0).cast("bigint").alias("epoch"),
    )
    out = kind == "sched_switch_out"
    switches = rows.where(F.startswith(kind, F.lit("sched_switch_"))).select(
        "*",
        F.when(kind == "sched_switch_in", F.col("related_target_tid")).otherwise(F.col("tid")).alias("prev_tid"),
        F.when(kind == "sched_switch_in", F.col("tid")).otherwise(F.col("related_target_tid")).alias("next_tid"),
        F.when(out | (kind == "sched_switch_both"), C.state_from_bits(F.col("previous_state"))).otherwise("unknown").alias("state"),
    )
    columns = ["capture_id", "event_index", "event_id", "ts_ns", "cpu", "tid", "event_type", "step", "state", "waker_tid", "lock_id"]
    none = F.lit(None)
    switched = S.expand_switches(switches).withColumn("waker_tid", none.cast("bigint"))
    wakes = rows.where(kind.isin("sched_waking", "sched_wakeup", "sched_wakeup_new")).select(
        "*",
        F.when(kind == "sched_waking", "waking").otherwise("wakeup").alias("event_type"),
        F.when(kind == "sched_waking", F.col("related_target_tid")).alias("waker_tid"),
    )
    woken = S.enrich_wakers(wakes).select("*", (F.col("event_index") * 2).alias("step"), none.cast("string").alias("state"))
    others = rows.where(~F.startswith(kind, F.lit("sched_switch_")) & ~kind.isin("sched_waking", "sched_wakeup", "sched_wakeup_new"))
    result = F.col("wait_result")
    from gristmill.operators.locks import wait_outcome

    plain = others.select(
        "*",
        F.when(kind == "sched_migrate", "migrate")
        .when(kind == "lock_wait_ended", wait_outcome(result, F.lit(True)))
        .otherwise(kind)
        .alias("event_type"),
        (F.col("event_index") * 2).alias("step"),
        none.cast("string").alias("state"),
        none.cast("bigint").alias("waker_tid"),
    ).withColumn("cpu", F.when(kind == "sched_migrate", F.col("destination_cpu")).otherwise(F.col("cpu")))
    return switched.select(columns).unionByName(woken.select(columns)).unionByName(plain.select(columns))
