"""Runtime-lock sources other than the normalized stream: native probe, CPython, JFR, pprof.

Each gives raw events with the columns ``runtime_ndjson.accept_events`` reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.ordered import dense_index, running, running_last
from gristmill.operators.runtime_locks import lifo_pairs

# fixed values: probe records, timing floor, time forms, profile sections, lock symbols
PROBE = (
    "record_type string, sequence bigint, source_event_id string, event_kind string, timestamp_ns bigint, pid int,"
    " tid bigint, raw_lock_token string, lock_kind string, related_source_event_id string, duration_ns bigint,"
    " hold_duration_ns bigint, result string, stack_id string"
)
CPYTHON_FLOOR_NS = 10_000
TIMESTAMP = r"^(.*?)(?:\.([0-9]{1,9}))?([+-][0-9]{2}:[0-9]{2}|Z)$"
DURATION = r"^PT([0-9]+)(?:\.([0-9]{1,9}))?S$"
SAMPLE = r"^\s*([0-9]+)\s+([0-9]+):\s*([0-9]+(?:\s+[0-9]+)*)?\s*$"
LOCATION = r"^\s*([0-9]+):\s+0x[0-9a-fA-F]+\s+M=[0-9]+(?:\s+(.*))?$"
PPROF_FRAME = r"^(.+?)\s+(.+):([0-9]+):[0-9]+\s+s=[0-9]+$"
SECTIONS = ("Samples:", "Locations", "Mappings")
GO_LOCKS = (
    ("runtime_internal", r"^runtime\._LostContendedRuntimeLock$"),
    ("wait_group", r"^sync\.\(\*WaitGroup\)\."),
    ("condition", r"^sync\.\(\*Cond\)\."),
    ("channel", r"^runtime\.(?:chan|selectgo)"),
    ("mutex", r"^sync\.\(\*(?:Mutex|RWMutex)\)\."),
)
JFR_EVENTS = {
    "jdk.JavaMonitorEnter": "mutex", "jdk.JavaMonitorWait": "condition", "jdk.ThreadPark": "park",
}


def _raw(rows: DataFrame, **columns: Column) -> DataFrame:
    """Raw event columns; what a source does not have is null."""
    kinds = {
        "pre_reason": "string", "source_event_id": "string", "event_kind": "string", "ts_ns": "bigint",
        "context": "string", "owner_context": "string", "parked_context": "string", "source_lock_id": "string",
        "lock_kind": "string", "source_stack_id": "string", "wait_begin_source_event_id": "string",
        "duration_ns": "bigint", "outcome": "string", "wait_end_source_event_id": "string",
        "acquire_source_event_id": "string", "hold_duration_ns": "bigint", "observed_count": "bigint",
        "estimated_count": "double", "cumulative_wait_ns": "bigint",
    }
    return rows.select(
        "capture_id",
        "line_no",
        *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()],
        *[columns[n].alias(n) for n in columns if n not in kinds],
    )


def _thread(pid: Column, tid: Column) -> Column:
    return F.concat_ws("|", F.lit("os_thread"), pid, tid, F.lit(""))


def probe_events(lines: DataFrame) -> DataFrame:
    """Probe lines in (time, sequence) order, numbered per capture."""
    rows = lines.withColumn("e", F.from_json("line", PROBE)).where(F.col("e.record_type") == "probe_event")
    flat = rows.select("capture_id", "e.*")
    # spans of a second keep the global sort of a capture in many tasks
    return dense_index(
        flat, ["capture_id"], ["timestamp_ns", "sequence"], F.floor(F.col("timestamp_ns") / F.lit(1_000_000_000)), "line_no"
    )


def _pair_violations(events: DataFrame, threshold_ns: int | None) -> DataFrame:
    """Event ids whose wait or hold pair breaks nesting, identity or timing."""
    kind = F.col("event_kind")
    subject = ["capture_id", "tid", "raw_lock_token", "lock_kind", "family"]
    pairs = events.where(kind.isin("wait_begin", "wait_end", "acquire", "release")).select(
        "capture_id",
        "tid",
        "raw_lock_token",
        "lock_kind",
        F.when(kind.isin("wait_begin", "wait_end"), "wait").otherwise("hold").alias("family"),
        F.col("line_no").alias("event_index"),
        F.col("source_event_id").alias("event_id"),
        F.when(kind.isin("wait_begin", "acquire"), 1).otherwise(-1).alias("step"),
        F.col("related_source_event_id").alias("ref_id"),
        "timestamp_ns",
        F.when(kind == "wait_end", F.col("duration_ns")).when(kind == "release", F.col("hold_duration_ns")).alias("lasted"),
    )
    checked = lifo_pairs(pairs, subject)
    begins = pairs.where("step > 0").select(
        "capture_id", F.col("event_id").alias("partner_id"), F.col("timestamp_ns").alias("begun_ns")
    )
    timed = checked.join(begins, ["capture_id", "partner_id"], "left")
    wrong = F.col("violation") | (
        F.col("lasted").isNotNull() & (F.col("lasted") != F.col("timestamp_ns") - F.col("begun_ns"))
    )
    if threshold_ns is not None:
        wrong = wrong | ((F.col("family") == "wait") & (F.col("lasted") < threshold_ns))
    return timed.where(F.coalesce(wrong, F.lit(False))).select(
        "capture_id", F.col("event_id").alias("source_event_id"), F.lit("INVALID_EVENT_PAIR").alias("pair_reason")
    )


def native_events(lines: DataFrame, hold_observed: bool = True, threshold_ns: int | None = None) -> DataFrame:
    """Native probe records as raw events; broken pairs carry a reason."""
    events = probe_events(lines)
    events = events.join(_pair_violations(events, threshold_ns), ["capture_id", "source_event_id"], "left")
    kind, related = F.col("event_kind"), F.col("related_source_event_id")
    held = (kind == "release") & F.lit(hold_observed)
    return _raw(
        events,
        pre_reason=F.col("pair_reason"),
        source_event_id=F.col("source_event_id"),
        event_kind=kind,
        ts_ns=F.col("timestamp_ns"),
        context=_thread(F.col("pid"), F.col("tid")),
        source_lock_id=F.col("raw_lock_token"),
        lock_kind=F.col("lock_kind"),
        source_stack_id=F.col("stack_id"),
        wait_begin_source_event_id=F.when(kind == "wait_end", related),
        duration_ns=F.when(kind == "wait_end", F.col("duration_ns")),
        outcome=F.when(kind == "wait_end", F.col("result")),
        wait_end_source_event_id=F.when(kind == "acquire", related),
        acquire_source_event_id=F.when(held, related),
        hold_duration_ns=F.when(held, F.col("hold_duration_ns")),
    )


def cpython_events(lines: DataFrame, thresholded: bool = False) -> DataFrame:
    """CPython probe records as raw events; releases carry no pair and no hold time."""
    events = probe_events(lines)
    waits = events.where(F.col("event_kind").isin("wait_begin", "wait_end"))
    broken = _pair_violations(waits, CPYTHON_FLOOR_NS if thresholded else None)
    events = events.join(broken, ["capture_id", "source_event_id"], "left")
    kind, related = F.col("event_kind"), F.col("related_source_event_id")
    bad_result = (kind == "wait_end") & ~F.col("result").isin("acquired", "notified", "timed_out")
    return _raw(
        events,
        pre_reason=F.when(bad_result, "INVALID_EVENT").otherwise(F.col("pair_reason")),
        source_event_id=F.col("source_event_id"),
        event_kind=kind,
        ts_ns=F.col("timestamp_ns"),
        context=_thread(F.col("pid"), F.col("tid")),
        source_lock_id=F.col("raw_lock_token"),
        lock_kind=F.col("lock_kind"),
        source_stack_id=F.col("stack_id"),
        wait_begin_source_event_id=F.when(kind == "wait_end", related),
        duration_ns=F.when(kind == "wait_end", F.col("duration_ns")),
        outcome=F.when(kind == "wait_end", F.col("result")),
        wait_end_source_event_id=F.when(kind == "acquire", related),
    )


def jfr_time_ns(text: Column) -> Column:
    """ISO time with up to nine fraction digits and an offset, as nanoseconds since 1970."""
    zone = F.regexp_extract(text, TIMESTAMP, 3)
    whole = F.concat(
        F.regexp_extract(text, TIMESTAMP, 1), F.when(zone == "Z", F.lit("+00:00")).otherwise(zone)
    )
    seconds = F.unix_seconds(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return seconds * 1_000_000_000 + F.rpad(F.regexp_extract(text, TIMESTAMP, 2), 9, "0").cast("bigint")


def jfr_duration_ns(text: Column) -> Column:
    """``PT<seconds>[.<fraction>]S`` as nanoseconds."""
    seconds = F.regexp_extract(text, DURATION, 1).try_cast("bigint")
    return seconds * 1_000_000_000 + F.rpad(F.regexp_extract(text, DURATION, 2), 9, "0").cast("bigint")


_JFR_THREAD = "struct<osThreadId: bigint, javaThreadId: bigint, virtual: boolean>"
JFR_EVENT = (
    "struct<type: string, `values`: struct<startTime: string, duration: string,"
    f" eventThread: {_JFR_THREAD}, previousOwner: {_JFR_THREAD}, notifier: {_JFR_THREAD}, timedOut: boolean,"
    " address: bigint, amount: bigint, stackTrace: struct<truncated: boolean, frames: array<struct<method: struct<name: string,"
    " type: struct<name: string, package: struct<module: struct<name: string>>>>>>>>>"
)
JFR = f"struct<recording: struct<events: array<{JFR_EVENT}>>>"


def _jfr_thread(thread: Column, pid: Column) -> Column:
    virtual = F.coalesce(thread["virtual"], F.lit(False))
    return F.when(
        thread.isNotNull(),
        F.concat_ws(
            "|",
            F.when(virtual, "java_virtual_thread").otherwise("java_platform_thread"),
            pid,
            F.when(virtual, "").otherwise(thread["osThreadId"].cast("string")),
            F.concat(F.lit("java-thread-"), thread["javaThreadId"]),
        ),
    )


def jfr_rows(documents: DataFrame) -> DataFrame:
    """One row per recording event of ``capture_id, target_pid, document``."""
    return documents.select("capture_id", "target_pid", F.from_json("document", JFR).alias("d")).select(
        "capture_id", "target_pid", F.posexplode("d.recording.events").alias("source_index", "event")
    )


def jfr_frames(trace: Column) -> Column:
    """Frames root first: ``Class.method`` and the module it belongs to."""
    frames = F.transform(
        trace["frames"],
        lambda f: F.struct(
            F.concat(F.replace(f["method"]["type"]["name"], F.lit("/"), F.lit(".")), F.lit("."), f["method"]["name"]).alias("symbol"),
            F.coalesce(
                F.nullif(f["method"]["type"]["package"]["module"]["name"], F.lit("")), F.lit("unnamed-java-module")
            ).alias("module"),
        ),
    )
    return F.when(F.size(frames) > 0, F.reverse(frames))


def jfr_events(documents: DataFrame) -> DataFrame:
    """Monitor and park events as thresholded wait ends, timed relative to the first start."""
    return jfr_waits(jfr_rows(documents))


def jfr_waits(rows: DataFrame) -> DataFrame:
    """``jfr_events`` of the rows ``capture_id, target_pid, source_index, event``."""
    e = F.col("event")
    v = e["values"]
    starts = rows.where(e["type"].isin(*JFR_EVENTS)).withColumn("start_ns", jfr_time_ns(v["startTime"])).withColumn(
        "duration_ns", jfr_duration_ns(v["duration"])
    )
    first = starts.groupBy("capture_id").agg(F.min("start_ns").alias("first_ns"))
    kinds = F.create_map(*[x for k, name in JFR_EVENTS.items() for x in (F.lit(k), F.lit(name))])
    timed = starts.join(first, "capture_id").withColumn(
        "end_ns", F.col("start_ns") - F.col("first_ns") + F.col("duration_ns")
    )
    timed = timed.withColumn("source_event_id", F.concat(F.lit("jfr-event-"), F.col("source_index") + 1))
    numbered = dense_index(
        timed, ["capture_id"], ["end_ns", "source_event_id"], F.floor(F.col("end_ns") / F.lit(1_000_000_000)), "line_no"
    )
    outcome = (
        F.when(e["type"] == "jdk.JavaMonitorEnter", "acquired")
        .when((e["type"] == "jdk.JavaMonitorWait") & F.coalesce(v["timedOut"], F.lit(False)), "timed_out")
        .when((e["type"] == "jdk.JavaMonitorWait") & v["notifier"].isNotNull(), "notified")
        .otherwise("unknown")
    )
    lock_kind = F.try_element_at(kinds, e["type"])
    return _raw(
        numbered,
        source_event_id=F.col("source_event_id"),
        event_kind=F.lit("wait_end"),
        ts_ns=F.col("end_ns"),
        context=_jfr_thread(v["eventThread"], F.col("target_pid")),
        owner_context=F.when(
            e["type"] == "jdk.JavaMonitorEnter", _jfr_thread(v["previousOwner"], F.col("target_pid"))
        ),
        source_lock_id=F.when(v["address"] != 0, F.concat_ws("-", F.lit("jfr-lock"), v["address"], lock_kind)),
        lock_kind=lock_kind,
        source_stack_id=F.sha2(F.to_json(jfr_frames(v["stackTrace"])), 256),
        duration_ns=F.col("duration_ns"),
        outcome=outcome,
        frames=jfr_frames(v["stackTrace"]),
    )


def jfr_lost_bytes(documents: DataFrame) -> DataFrame:
    e = F.col("event")
    return (
        jfr_rows(documents)
        .where(e["type"] == "jdk.DataLoss")
        .groupBy("capture_id")
        .agg(F.sum(e["values"]["amount"]).alias("lost_bytes"))
    )


def _pprof_frame(text: Column) -> Column:
    symbol = F.trim(F.regexp_extract(text, PPROF_FRAME, 1))
    unknown = symbol.isin("?", "??", "<unknown>")
    leaf = F.element_at(F.split(F.replace(F.regexp_extract(text, PPROF_FRAME, 2), F.lit("\\"), F.lit("/")), "/"), -1)
    line = F.regexp_extract(text, PPROF_FRAME, 3).try_cast("int")
    return F.struct(
        F.when(unknown, "[unknown]").otherwise(symbol).alias("symbol"),
        F.when(~unknown & ~leaf.isin("", ".", ".."), leaf).alias("source_file"),
        F.when(~unknown & (line > 0), line).alias("source_line"),
    )


def pprof_samples(lines: DataFrame) -> DataFrame:
    """Samples of raw profile text with their frames root first, ``sample_no`` counting from 0.

    Sections and the location a frame line belongs to are running values over the line order.
    """
    text = F.col("line")
    rows = running(
        lines,
        ["capture_id"],
        "line_no",
        {
            "section": running_last(F.when(F.trim(text).isin(*SECTIONS), F.trim(text))),
            "location": running_last(F.when(text.rlike(LOCATION), F.regexp_extract(text, LOCATION, 1).try_cast("bigint"))),
        },
    )
    in_samples = (F.col("section") == "Samples:") & text.rlike(SAMPLE)
    samples = rows.where(in_samples).select(
        "capture_id",
        "line_no",
        F.regexp_extract(text, SAMPLE, 1).try_cast("bigint").alias("observed_count"),
        F.regexp_extract(text, SAMPLE, 2).try_cast("bigint").alias("cumulative_wait_ns"),
        F.transform(
            F.split(F.trim(F.regexp_extract(text, SAMPLE, 3)), r"\s+"), lambda x: x.try_cast("bigint")
        ).alias("locations"),
    )
    frame_text = F.when(text.rlike(LOCATION), F.regexp_extract(text, LOCATION, 2)).otherwise(F.trim(text))
    frames = (
        rows.where((F.col("section") == "Locations") & (F.trim(text) != "Locations") & (F.trim(text) != ""))
        .select("capture_id", "location", "line_no", frame_text.alias("text"))
        .where(F.col("text").rlike(PPROF_FRAME))
        .groupBy("capture_id", "location")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("line_no", _pprof_frame(F.col("text")).alias("f")))), lambda x: x["f"]
            ).alias("frames")
        )
    )
    # a sample lists its locations leaf first; its depth is bounded by the profile format
    placed = samples.select("*", F.posexplode("locations").alias("place", "location")).join(
        frames, ["capture_id", "location"], "left"
    )
    stacks = placed.groupBy("capture_id", "line_no").agg(
        F.max("observed_count").alias("observed_count"),
        F.max("cumulative_wait_ns").alias("cumulative_wait_ns"),
        F.count_if(F.col("frames").isNull()).alias("unknown_locations"),
        F.reverse(
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "frames"))), lambda x: x["frames"]))
        ).alias("frames"),
    )
    return dense_index(stacks, ["capture_id"], ["line_no"], F.floor(F.col("line_no") / F.lit(1 << 16)), "sample_no")


def _any_symbol(frames: Column, pattern: str) -> Column:
    return F.exists(frames, lambda f: f["symbol"].rlike(pattern))


def go_lock_kind(frames: Column, profile_kind: str) -> Column:
    """Lock kind from the Go symbols on the stack, first rule that fits."""
    out = None
    for kind, pattern in GO_LOCKS:
        hit = _any_symbol(frames, pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("mutex" if profile_kind == "mutex" else "unknown")


def pprof_events(lines: DataFrame, profile_kind: str, target_pid: int) -> DataFrame:
    """Profile samples as cumulative contention events; the estimated count is never derived."""
    rows = pprof_samples(lines)
    return _raw(
        rows.withColumn("line_no", F.col("sample_no").cast("bigint")),
        source_event_id=F.concat(F.lit("go-sample-"), F.col("sample_no") + 1),
        event_kind=F.lit("sampled_contention"),
        ts_ns=F.col("sample_no"),
        context=F.concat_ws("|", F.lit("process_aggregate"), F.lit(str(target_pid)), F.lit(""), F.lit("")),
        lock_kind=go_lock_kind(F.col("frames"), profile_kind),
        source_stack_id=F.sha2(F.to_json("frames"), 256),
        observed_count=F.col("observed_count"),
        cumulative_wait_ns=F.col("cumulative_wait_ns"),
        frames=F.col("frames"),
    )
