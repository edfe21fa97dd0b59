"""Scheduler and lock transcripts: one ``pid/tid [cpu] s.ns: group:event: payload`` per line.

``parse_trace`` is row-local; ``judge_trace`` adds what depends on order and on the target
threads; ``scheduler_events`` and ``lock_events`` give the normalized rows the operators read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import trace_codes as C
from gristmill.operators import locks as L
from gristmill.operators import sched as S
from gristmill.operators.ordered import running, running_max, running_sum
from gristmill.sources.lines import clean_text

# fixed values: line and payload forms, allowed events per mode, known lock flags
HEADER = (
    r"^\s*([0-9]+)(?:/|\s+)([0-9]+)\s+\[([0-9]+)\]\s+([0-9]+)\.([0-9]{9}):\s+"
    r"([a-z0-9_]+):([a-z0-9_]+):(?:\s*(.*))?$"
)
LOST = (
    r"^\s*(?:(?:[0-9]+/[0-9]+|[0-9]+\s+[0-9]+)\s+\[[0-9]+\]\s+[0-9]+\.[0-9]{9}:\s+(?:\S+:\s+)?)?"
    r"PERF_RECORD_LOST\s+lost\s+([0-9]+)\s*$"
)
SWITCH = (
    r"^prev_comm=.{0,16} prev_pid=([0-9]+) prev_prio=-?[0-9]+ prev_state=(\S+) ==> "
    r"next_comm=.{0,16} next_pid=([0-9]+) next_prio=-?[0-9]+$"
)
WAKEUP = r"^comm=.{0,16} pid=([0-9]+) prio=-?[0-9]+ target_cpu=([0-9]+)$"
MIGRATE = r"^comm=.{0,16} pid=([0-9]+) prio=-?[0-9]+ orig_cpu=([0-9]+) dest_cpu=([0-9]+)$"
LOCK_BEGIN = r"^((?:0x)?[0-9a-fA-F]{1,16}) \(flags=([A-Z0-9_|]+)\)$"
LOCK_END = r"^((?:0x)?[0-9a-fA-F]{1,16}) \(ret=(-?[0-9]+)\)$"
LOCK_LEGACY = r"^((?:0x)?[0-9a-fA-F]{1,16}) ([^\x00\r\n]+)$"
ADDRESS = r"^(?:0x)?[0-9a-fA-F]{1,16}$"
FIELD = r"(?:^|[\s,])([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:=|:)\s*([^\s,]+)"
SCHED_EVENTS = ("sched_switch", "sched_waking", "sched_wakeup", "sched_wakeup_new", "sched_migrate_task")
LOCK_EVENTS = (
    "contention_begin", "contention_end", "lock_acquire", "lock_acquired", "lock_contended", "lock_release",
)
FUTEX_EVENTS = ("sys_enter_futex", "sys_exit_futex")
LOCK_FLAGS = ("0", "SPIN", "READ", "WRITE", "RT", "PERCPU", "MUTEX")
LABELS = {
    "sched_switch": ("prev_pid=", " prev_prio=", " prev_state=", " next_pid=", " next_prio="),
    "sched_wakeup": (" pid=", " prio=", " target_cpu="),
    "sched_migrate_task": (" pid=", " prio=", " orig_cpu=", " dest_cpu="),
}


def _count(text: Column, label: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(label), F.lit("")))) / len(label)


def _once(text: Column, labels: tuple[str, ...]) -> Column:
    good = F.lit(True)
    for label in labels:
        good = good & (_count(text, label) == 1)
    return good


def parse_trace(lines: DataFrame) -> DataFrame:
    """Add ``header_*`` fields, ``lost_count`` and the row-local ``outcome`` to line rows.

    ``outcome`` is ``blank``, ``lost``, ``malformed`` or ``event``.
    """
    line = F.regexp_replace(clean_text(F.col("line")), r"[\r\n]+$", "")
    rows = lines.withColumn("line", line)
    line = F.col("line")

    def part(i: int) -> Column:
        return F.regexp_extract(line, HEADER, i)

    outcome = (
        F.when(F.trim(line) == "", "blank")
        .when(F.contains(line, F.lit("\x00")), "malformed")
        .when(line.rlike(LOST), "lost")
        .when(~line.rlike(HEADER), "malformed")
        .otherwise("event")
    )
    good = F.col("outcome") == "event"
    return (
        rows.withColumn("outcome", outcome)
        .withColumn("lost_count", F.when(F.col("outcome") == "lost", F.regexp_extract(line, LOST, 1).try_cast("bigint")))
        .withColumn("pid", F.when(good, part(1).try_cast("int")))
        .withColumn("header_tid", F.when(good, part(2).try_cast("bigint")))
        .withColumn("cpu", F.when(good, part(3).try_cast("int")))
        .withColumn(
            "ts_ns", F.when(good, part(4).try_cast("bigint") * 1_000_000_000 + part(5).try_cast("bigint"))
        )
        .withColumn("group", F.when(good, part(6)))
        .withColumn("event", F.when(good, part(7)))
        .withColumn("payload", F.when(good, part(8)))
    )


def _in_mode(mode: str) -> Column:
    group, event = F.col("group"), F.col("event")
    if mode in ("sched", "off_cpu"):
        return (group == "sched") & event.isin(*SCHED_EVENTS)
    return ((group == "lock") & event.isin(*LOCK_EVENTS)) | ((group == "syscalls") & event.isin(*FUTEX_EVENTS))


def judge_trace(parsed: DataFrame, targets: DataFrame, mode: str) -> DataFrame:
    """Add payload fields, scope and ``disposition`` to every non-blank line.

    ``targets`` has one row per capture: ``capture_id, target_pid, target_tids`` (array).  Rows
    behind the running time of their capture are ``out_of_order``; rows without a target thread
    are ``foreign`` and lose their identities.  ``epoch`` counts lost records before the row.
    """
    rows = running(
        parsed.where(F.col("outcome") != "blank"),
        ["capture_id"],
        "line_no",
        {
            "max_ts": running_max(F.col("ts_ns"), inclusive=False),
            "epoch": running_sum((F.col("outcome") == "lost").cast("bigint")),
        },
    ).join(targets, "capture_id", "left")
    event, payload = F.col("event"), F.col("payload")
    tids = F.coalesce("target_tids", F.array().cast("array<bigint>"))

    def target(tid: Column) -> Column:
        return F.when(F.array_contains(tids, tid), tid)

    wake = event.isin("sched_waking", "sched_wakeup", "sched_wakeup_new")
    shape = (
        F.when(event == "sched_switch", _once(payload, LABELS["sched_switch"]) & payload.rlike(SWITCH))
        .when(wake, _once(payload, LABELS["sched_wakeup"]) & payload.rlike(WAKEUP))
        .when(event == "sched_migrate_task", _once(payload, LABELS["sched_migrate_task"]) & payload.rlike(MIGRATE))
        .when(event == "contention_begin", payload.rlike(LOCK_BEGIN))
        .when(event == "contention_end", payload.rlike(LOCK_END))
        .when(event.isin("lock_acquired", "lock_contended", "lock_release"), payload.rlike(LOCK_LEGACY))
        .otherwise(F.lit(True))
    )
    is_sched = F.col("group") == "sched"
    header_task = F.when(F.col("pid") == F.col("target_pid"), target(F.col("header_tid")))
    woken = F.regexp_extract(payload, WAKEUP, 1).try_cast("bigint")
    moved = F.regexp_extract(payload, MIGRATE, 1).try_cast("bigint")
    fields = F.map_from_entries(
        F.array_distinct(
            F.transform(
                F.regexp_extract_all(payload, F.lit(FIELD), F.lit(1)),
                lambda name, i: F.struct(name, F.get(F.regexp_extract_all(payload, F.lit(FIELD), F.lit(2)), i)),
            )
        )
    )
    names = F.regexp_extract_all(payload, F.lit(FIELD), F.lit(1))
    leftovers = F.regexp_replace(F.regexp_replace(payload, FIELD, ""), r"[ ,]+", "")
    unique = (F.size(F.array_distinct(names)) == F.size(names)) & (leftovers == "")
    flags = F.split(F.regexp_extract(payload, LOCK_BEGIN, 2), r"\|")
    known_flags = (
        (F.size(F.array_distinct(flags)) == F.size(flags))
        & (F.size(F.array_except(flags, F.array(*[F.lit(f) for f in LOCK_FLAGS]))) == 0)
        & (~F.array_contains(flags, "0") | (F.size(flags) == 1))
    )
    is_futex = event == "sys_enter_futex"
    safe_fields = F.when(is_futex & unique, fields)
    address = (
        F.when(event == "contention_begin", F.regexp_extract(payload, LOCK_BEGIN, 1))
        .when(event == "contention_end", F.regexp_extract(payload, LOCK_END, 1))
        .when(event.isin("lock_acquired", "lock_contended", "lock_release"), F.regexp_extract(payload, LOCK_LEGACY, 1))
        .when(is_futex, F.try_element_at(safe_fields, F.lit("uaddr")))
    )
    op = C.parse_integer(F.try_element_at(safe_fields, F.lit("op")))
    rows = (
        rows.withColumn("prev_tid", F.when(event == "sched_switch", target(F.regexp_extract(payload, SWITCH, 1).try_cast("bigint"))))
        .withColumn("next_tid", F.when(event == "sched_switch", target(F.regexp_extract(payload, SWITCH, 3).try_cast("bigint"))))
        .withColumn("state", F.when(event == "sched_switch", C.state_from_letter(F.regexp_extract(payload, SWITCH, 2))))
        .withColumn(
            "tid",
            F.when(wake, target(woken)).when(event == "sched_migrate_task", target(moved)).when(~is_sched, header_task),
        )
        .withColumn("waker_tid", F.when(event == "sched_waking", header_task))
        .withColumn("destination_cpu", F.regexp_extract(payload, MIGRATE, 3).try_cast("int"))
        .withColumn("address", address)
        .withColumn("result", F.when(event == "contention_end", F.regexp_extract(payload, LOCK_END, 2).try_cast("bigint")))
        .withColumn("known_flags", F.when(event == "contention_begin", known_flags))
        .withColumn("futex_kind", F.when(is_futex, C.futex_kind(op)))
        .withColumn("futex_operation", F.when(is_futex, C.futex_operation(op)))
        .withColumn("__op", op)
    )
    foreign = F.when(is_sched, F.coalesce("prev_tid", "next_tid", "tid").isNull()).otherwise(F.col("tid").isNull())
    outcome = F.col("outcome")
    # lock and futex rows check their thread before their payload, scheduler rows after it
    disposition = (
        F.when(outcome != "event", outcome)
        .when(F.col("ts_ns") < F.col("max_ts"), "out_of_order")
        .when(~F.coalesce(_in_mode(mode), F.lit(False)), "unsupported")
        .when(~is_sched & foreign, "foreign")
        .when(~F.coalesce(shape, F.lit(False)), "malformed")
        .when(is_sched & foreign, "foreign")
        .when(event.isin("lock_acquire", "sys_exit_futex"), "unsupported")
        .when(is_futex & (F.col("address").isNull() | ~F.col("address").rlike(ADDRESS) | F.col("__op").isNull()), "malformed")
        .when(is_futex & F.col("futex_kind").isNull(), "unsupported")
        .otherwise("accepted")
    )
    hidden = F.col("disposition") == "foreign"
    return (
        rows.withColumn("disposition", disposition)
        .withColumn("pid", F.when(~hidden, F.col("pid")))
        .withColumn("header_tid", F.when(~hidden, F.col("header_tid")))
        .drop("max_ts", "__op", "target_pid", "target_tids", "payload", "line")
    )


def scheduler_events(judged: DataFrame) -> DataFrame:
    """Accepted rows as scheduler events, switches expanded per thread, wakeups with their waker."""
    accepted = judged.where(F.col("disposition") == "accepted").withColumn("event_index", F.col("line_no"))
    event = F.col("event")
    eid = C.event_id(F.col("line_no"), F.col("ts_ns"), F.col("cpu"), event)
    accepted = accepted.withColumn("event_id", eid)
    columns = ["capture_id", "event_index", "event_id", "ts_ns", "cpu", "state", "step", "tid", "event_type", "waker_tid", "waking_used"]
    switches = S.expand_switches(accepted.where(event == "sched_switch").drop("waker_tid"))
    none = F.lit(None).cast("bigint")
    switches = switches.withColumn("waker_tid", none).withColumn("waking_used", F.lit(False))
    wakes = accepted.where(event.isin("sched_waking", "sched_wakeup", "sched_wakeup_new")).withColumn(
        "event_type", F.when(event == "sched_waking", "waking").otherwise("wakeup")
    )
    woken = (
        S.enrich_wakers(wakes)
        .withColumn("step", F.col("event_index") * 2)
        .withColumn("waking_used", F.col("pending") == 1)
    )
    moves = accepted.where(event == "sched_migrate_task").select(
        "*", F.lit("migrate").alias("event_type"), (F.col("event_index") * 2).alias("step")
    ).withColumn("cpu", F.col("destination_cpu")).withColumn("waker_tid", none).withColumn("waking_used", F.lit(False))
    return switches.select(columns).unionByName(woken.select(columns)).unionByName(moves.select(columns))


def lock_events(judged: DataFrame, key: bytes) -> DataFrame:
    """Accepted rows as lock events with pseudonymous lock ids; contention phases folded."""
    accepted = judged.where(F.col("disposition") == "accepted").select(
        "*", F.col("line_no").alias("event_index"), C.lock_pseudonym(key, F.col("address")).alias("lock_id")
    )
    event = F.col("event")
    eid = C.event_id(F.col("line_no"), F.col("ts_ns"), F.col("cpu"), event)
    accepted = accepted.withColumn("event_id", eid)
    phases = L.merge_contention(
        accepted.where(event.isin("contention_begin", "contention_end")).withColumn(
            "event_type",
            F.when(event == "contention_end", "end").when(F.col("known_flags"), "begin").otherwise("begin_unknown"),
        )
    )
    columns = ["capture_id", "tid", "lock_id", "event_index", "event_id", "ts_ns", "cpu"]
    modern = phases.select(*columns, F.col("action").alias("event_type"))
    plain = accepted.where(~event.isin("contention_begin", "contention_end")).select(
        *columns,
        F.coalesce(
            "futex_kind",
            F.when(event == "lock_contended", "lock_wait").when(event == "lock_acquired", "acquired").otherwise("released"),
        ).alias("event_type"),
    )
    return modern.unionByName(plain).withColumn("owner_evidence", F.lit("unavailable")).withColumn(
        "path", F.array().cast("array<string>")
    )


# fixed values: contention rows that are no events of their own
FOLDED = ("merged", "poisoned", "unsupported")


def conversion_counters(judged: DataFrame, events: DataFrame, mode: str) -> DataFrame:
    """Per capture: input, emitted, malformed, late, unsupported, foreign, lost, enrichment counts."""
    d = F.col("disposition")
    counts = judged.groupBy("capture_id").agg(
        F.count_if(d != "lost").alias("input"),
        F.count_if(d == "malformed").alias("malformed"),
        F.count_if(d == "out_of_order").alias("out_of_order"),
        F.count_if(d == "unsupported").alias("unsupported_lines"),
        F.count_if(d == "foreign").alias("foreign"),
        F.coalesce(F.sum("lost_count"), F.lit(0)).alias("lost"),
        F.count_if((d == "accepted") & (F.col("event") == "sched_waking")).alias("__waking"),
    )
    if mode == "lock":
        kind = F.col("event_type")
        more = events.groupBy("capture_id").agg(
            F.count_if(~kind.isin(*FOLDED)).alias("emitted"),
            F.count_if(kind.isin("poisoned", "unsupported")).alias("__more"),
            F.count_if(kind == "merged").alias("enrichment"),
        )
    else:
        more = events.groupBy("capture_id").agg(
            # one record may give two thread rows
            F.count_distinct("event_id").alias("emitted"),
            F.count_if("waking_used").alias("enrichment"),
        ).withColumn("__more", F.lit(0).cast("bigint"))
    out = counts.join(more, "capture_id", "left").fillna(0)
    unused = F.col("__waking") - F.col("enrichment") if mode != "lock" else F.lit(0)
    return out.withColumn("unsupported", F.col("unsupported_lines") + F.col("__more") + unused).drop(
        "__waking", "__more", "unsupported_lines"
    )
