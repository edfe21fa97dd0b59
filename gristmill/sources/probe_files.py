"""Whole probe files: header, stacks, events and footer in one pass, judged line by line.

A probe file is JSON lines of four kinds.  It is taken as a whole or not at all: the first line that
breaks a rule decides, and a file without its footer was cut off.  Every rule of a line looks at that line,
at counts and last values of the lines before it (running values over spans, no task holds a file) and at
the event it names, so all lines of all files are judged at once.  A line is judged as if all lines before it
were good, so events before it are known by their sequence, a lock by its last kind, and an open begin by its
depth as long as no end named it; only the first bad line of a file has a meaning of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.ordered import Running, cut, cut_texts, running_last, running_sum, running_within
from gristmill.sources.adapters import CPYTHON_FLOOR_NS, _raw, _thread

# fixed values: the fields of each kind of record in both forms of the file, id forms, lock kinds, outcomes
_FRAME = "struct<symbol: string, module: string, source_file: string, source_line: bigint, is_runtime: boolean, is_unknown: boolean>"
_RECORD = (
    "schema_version string, record_type string, protocol string, protocol_version string, runtime string, runtime_version string, adapter_id string,"
    " adapter_version string, backend_id string, backend_version string, free_threaded boolean, pid bigint, uid bigint, target_start_time_ticks bigint,"
    " observed_target_tids array<bigint>, target_kind string, container_reference string, semantics string, duration_threshold_ns bigint, max_events bigint,"
    " visible_lock_kinds array<string>, fast_path_visibility string, owner_is_source_observed boolean, hold_time_is_source_observed boolean,"
    f" stack_id string, frames array<{_FRAME}>, sequence bigint, source_event_id string, event_kind string, timestamp_ns bigint, tid bigint, raw_lock_token string,"
    " lock_kind string, related_source_event_id string, duration_ns bigint, hold_duration_ns bigint, result string, declared_event_count bigint,"
    " lost_event_count bigint, truncated boolean"
)
_EVENT = (
    "schema_version", "record_type", "sequence", "source_event_id", "event_kind", "timestamp_ns", "pid", "tid", "raw_lock_token", "lock_kind",
    "related_source_event_id", "duration_ns", "result", "stack_id",
)
_FOOTER = ("schema_version", "record_type", "protocol", "pid", "sequence", "declared_event_count", "lost_event_count", "truncated")
EVENT_KINDS = ("wait_begin", "wait_end", "acquire", "release")
EXACT_EVENTS = 20_000


@dataclass(frozen=True)
class Form:
    """One form of probe file: names, id patterns and the fields each kind of record has."""

    prefix: str
    protocol: str
    id_prefix: str
    stack_pattern: str
    token_pattern: str
    lock_kinds: tuple[str, ...]
    header: tuple[str, ...]
    event: tuple[str, ...]
    footer: tuple[str, ...]
    stacks_first: bool  # stacks come before all events
    footer_after: int  # the footer's sequence minus the number of events
    max_depth: int | None = None


NATIVE = Form(
    prefix="probe",
    protocol="native_pthread_probe",
    id_prefix="e",
    stack_pattern=r"^s[1-9][0-9]{0,19}$",
    token_pattern=r"^[a-f0-9]{16}$",
    lock_kinds=("mutex", "recursive_mutex", "rwlock_read", "rwlock_write", "condition"),
    header=(
        "schema_version", "record_type", "protocol", "protocol_version", "runtime", "runtime_version", "adapter_id", "adapter_version", "backend_id",
        "backend_version", "pid", "uid", "target_start_time_ticks", "observed_target_tids", "target_kind", "container_reference", "semantics",
        "duration_threshold_ns", "max_events", "visible_lock_kinds", "fast_path_visibility", "owner_is_source_observed", "hold_time_is_source_observed",
    ),
    event=(*_EVENT, "hold_duration_ns"),
    footer=_FOOTER,
    stacks_first=True,
    footer_after=1,
)
CPYTHON = Form(
    prefix="cpython",
    protocol="cpython_threading_probe",
    id_prefix="event-",
    stack_pattern=r"^stack-[1-9][0-9]{0,19}$",
    token_pattern=r"^lock-[1-9][0-9]{0,19}$",
    lock_kinds=("condition", "mutex", "recursive_mutex", "semaphore"),
    header=(
        "schema_version", "record_type", "protocol", "protocol_version", "runtime_version", "free_threaded", "pid", "uid", "target_start_time_ticks",
        "semantics", "duration_threshold_ns", "max_events", "visible_lock_kinds",
    ),
    event=_EVENT,
    footer=(*_FOOTER, "observed_target_tids"),
    stacks_first=False,
    footer_after=0,
    max_depth=32,
)


@dataclass(frozen=True)
class ProbeFiles:
    """``captures`` (one row per file with its verdict), ``problems`` (bad lines), and the records by kind.

    ``stacks`` and ``events`` hold the records of all files; join with the accepted captures.
    """

    captures: DataFrame
    problems: DataFrame
    stacks: DataFrame
    events: DataFrame


def _all(*conditions: Column) -> Column:
    """All true; null counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def _text(name: str, most: int = 4096) -> Column:
    return F.length(name).between(1, most)


def _sorted_unique(name: str) -> Column:
    return F.col(name) == F.array_sort(F.array_distinct(name))


def _good_header(form: Form) -> Column:
    c = F.col
    common = [
        c("schema_version") == "1.0", c("protocol") == form.protocol, c("protocol_version") == "1.0", _text("runtime_version", 256), c("pid") > 0, c("uid") >= 0,
        c("target_start_time_ticks") > 0, c("max_events") > 0, _sorted_unique("visible_lock_kinds"), F.size("visible_lock_kinds") > 0,
        F.size(F.array_except("visible_lock_kinds", F.array(*map(F.lit, form.lock_kinds)))) == 0,
    ]
    if form is CPYTHON:
        limit = F.when(c("semantics") == "exact", c("duration_threshold_ns").isNull()).otherwise(c("duration_threshold_ns") == CPYTHON_FLOOR_NS)
        version = c("runtime_version").rlike(r"^(3\.12|3\.13)\.[0-9]+(?:[+._-][A-Za-z0-9._-]+)?$")
        return _all(*common, version, c("free_threaded").isNotNull(), c("semantics").isin("exact", "thresholded"), limit, F.size("visible_lock_kinds") == len(form.lock_kinds))
    mode = F.when(
        c("semantics") == "exact",
        c("duration_threshold_ns").isNull() & (c("max_events") <= EXACT_EVENTS) & (c("fast_path_visibility") == "complete"),
    ).when(c("semantics") == "thresholded", (c("duration_threshold_ns") >= 0) & (c("fast_path_visibility") == "partial"))
    return _all(
        *common, mode, c("runtime") == "c_cpp", c("adapter_id") == "native-pthread", _text("adapter_version", 128), c("backend_id") == "ld-preload",
        _text("backend_version", 128), _sorted_unique("observed_target_tids"), F.array_contains("observed_target_tids", c("pid")), F.array_min("observed_target_tids") > 0,
        c("target_kind").isin("host", "docker"), (c("target_kind") == "docker") == c("container_reference").isNotNull(),
        c("owner_is_source_observed") == F.lit(False), c("hold_time_is_source_observed").isNotNull(),
    )


def _good_stack(form: Form) -> Column:
    def good(f: Column) -> Column:
        named = _all(F.length(f["symbol"]).between(1, 4096), f["is_runtime"].isNotNull(), f["is_unknown"].isNotNull())
        if form is CPYTHON:
            return named & _all(f["module"] == "python", F.length(f["source_file"]).between(1, 4096), f["source_line"] > 0, ~f["is_runtime"], ~f["is_unknown"])
        place = f["source_file"].isNull() & f["source_line"].isNull() | F.coalesce(F.length(f["source_file"]).between(1, 4096) & (f["source_line"].isNull() | (f["source_line"] > 0)), F.lit(False))
        return named & F.coalesce(F.length(f["module"]).between(1, 4096), F.lit(False)) & place

    depth = F.size("frames").between(1, form.max_depth) if form.max_depth else F.size("frames") > 0
    return _all(F.col("schema_version") == "1.0", F.col("stack_id").rlike(form.stack_pattern), depth, F.forall("frames", good))


def _good_event(form: Form) -> Column:
    c = F.col
    named = f"^{form.id_prefix}[1-9][0-9]{{0,19}}$"
    whole = _all(
        c("schema_version") == "1.0", c("sequence") > 0, c("source_event_id") == F.concat(F.lit(form.id_prefix), c("sequence").cast("string")),
        c("event_kind").isin(*EVENT_KINDS), c("timestamp_ns") >= 0, c("pid") > 0, c("tid") > 0, c("raw_lock_token").rlike(form.token_pattern),
        c("lock_kind").isin(*form.lock_kinds),
    )
    optional = _all(
        c("related_source_event_id").isNull() | c("related_source_event_id").rlike(named), c("stack_id").isNull() | c("stack_id").rlike(form.stack_pattern),
        c("duration_ns").isNull() | (c("duration_ns") >= 0), c("hold_duration_ns").isNull() | (c("hold_duration_ns") >= 0),
    )
    kind, related, lasted, held, result = c("event_kind"), c("related_source_event_id"), c("duration_ns"), c("hold_duration_ns"), c("result")
    if form is CPYTHON:
        shape = (
            F.when(kind == "wait_begin", related.isNull() & lasted.isNull() & (result == "unknown"))
            .when(kind == "wait_end", related.isNotNull() & lasted.isNotNull() & result.isin("acquired", "notified", "timed_out"))
            .when(kind == "acquire", related.isNotNull() & lasted.isNull() & (result == "acquired"))
            .otherwise(related.isNull() & lasted.isNull() & (result == "released"))
        )
    else:
        shape = (
            F.when(kind == "wait_begin", related.isNull() & lasted.isNull() & held.isNull() & (result == "unknown"))
            .when(kind == "wait_end", related.isNotNull() & lasted.isNotNull() & held.isNull() & result.isin("acquired", "notified", "timed_out", "failed"))
            .when(kind == "acquire", lasted.isNull() & held.isNull() & (result == "acquired"))
            .otherwise(related.isNotNull() & lasted.isNull() & (result == "released"))
        )
    return whole & optional & _all(shape)


def _good_footer(form: Form) -> Column:
    c = F.col
    rules = [
        c("schema_version") == "1.0", c("protocol") == form.protocol, c("pid") > 0, c("sequence") >= form.footer_after, c("declared_event_count") >= 0,
        c("lost_event_count") >= 0, c("truncated").isNotNull(), ~c("truncated") | (c("declared_event_count") > 0),
    ]
    if form is CPYTHON:
        rules += [_sorted_unique("observed_target_tids"), F.array_contains("observed_target_tids", c("pid"))]
    return _all(*rules)


def _records(lines: DataFrame, form: Form) -> DataFrame:
    """Lines with their fields, their kind, whether they stand alone (``shape_ok``), and what came before."""
    keys = F.json_object_keys("line")
    kinds = {"header": form.header, "stack": ("schema_version", "record_type", "stack_id", "frames"), "event": form.event, "footer": form.footer}
    rows = lines.select("capture_id", "line_no", keys.alias("keys"), F.from_json("line", _RECORD).alias("r"))
    rows = rows.select("capture_id", "line_no", "keys", "r.*")
    record = F.col("record_type")
    kind = F.when(F.col("keys").isNull(), "broken")
    for name in kinds:
        kind = kind.when(record == f"{form.prefix}_{name}", name)
    rows = rows.withColumn("kind", kind.otherwise("other"))
    optional = ("related_source_event_id", "stack_id") if form is CPYTHON else ()
    complete = F.lit(False)
    for name, fields in kinds.items():
        needed = F.array(*[F.lit(f) for f in fields if not (name == "event" and f in optional)])
        allowed = F.array(*[F.lit(f) for f in fields])
        fits = (F.size(F.array_except(needed, "keys")) == 0) & (F.size(F.array_except("keys", allowed)) == 0) & (F.size("keys") == F.size(F.array_distinct("keys")))
        complete = F.when(F.col("kind") == name, fits).otherwise(complete)
    good = (
        F.when(F.col("kind") == "header", _good_header(form)).when(F.col("kind") == "stack", _good_stack(form))
        .when(F.col("kind") == "event", _good_event(form)).when(F.col("kind") == "footer", _good_footer(form))
    )
    # what the rules across lines read; frames and texts of headers go no further than this table
    named = F.col("related_source_event_id")
    return cut_texts(
        rows.select(
            "capture_id", "line_no", "kind", F.coalesce(complete & good, F.lit(False)).alias("shape_ok"), "pid", "semantics", "duration_threshold_ns", "max_events", "visible_lock_kinds",
            "hold_time_is_source_observed", "stack_id", "frames", "sequence", "source_event_id", "event_kind", "timestamp_ns", "tid", "raw_lock_token", "lock_kind",
            "related_source_event_id", "duration_ns", "hold_duration_ns", "result", "declared_event_count", "lost_event_count", "truncated",
            F.array_position(F.array(*map(F.lit, form.lock_kinds)), F.col("lock_kind")).alias("lock_place"),
            F.when(named.startswith(form.id_prefix), F.expr(f"try_cast(substr(related_source_event_id, {len(form.id_prefix) + 1}) as bigint)")).alias("named"),
        )
    )


_HEAD = ["pid", "semantics", "duration_threshold_ns", "max_events", "visible_lock_kinds", "hold_time_is_source_observed"]


def _headers(records: DataFrame) -> DataFrame:
    """The header of each file, if it comes first."""
    first = records.groupBy("capture_id").agg(F.min("line_no").alias("line_no"))
    heads = records.where("kind = 'header'").select("capture_id", "line_no", F.struct(*_HEAD).alias("h"))
    return cut(heads.join(first, ["capture_id", "line_no"], "left_semi").drop("line_no"))


def _in_context(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines with their header, the counts before them, the last kind of their lock, the time and depth before, and whether their stack came before."""
    c = F.col
    one = lambda *names: F.when(c("kind").isin(*names), 1).otherwise(0).cast("long")
    step = lambda begin, end: F.when(c("event_kind") == begin, 1).when(c("event_kind") == end, -1).cast("long")
    of_event = lambda value: F.when(c("kind") == "event", value)
    groups = [
        ([], {"lines_before": running_sum(F.lit(1).cast("long"), False), "events_before": running_sum(one("event"), False), "footers_before": running_sum(one("footer"), False)}),
        (["tid"], {"time_before": running_last(of_event(c("timestamp_ns")), False)}),
        (["raw_lock_token"], {"place_before": running_last(of_event(c("lock_place")), False)}),
        (["stack_id"], {"stack_line": Running("min", F.when(c("kind") == "stack", c("line_no")), False)}),
        (
            ["tid", "raw_lock_token", "lock_kind"],
            {"wait_depth": running_sum(of_event(step("wait_begin", "wait_end"))), "hold_depth": running_sum(of_event(step("acquire", "release")))},
        ),
    ]
    return cut_texts(running_within(records.drop("frames", *_HEAD[1:]), ["capture_id"], "line_no", groups, headers))


def _with_pairs(events: DataFrame, form: Form) -> DataFrame:
    """Events with the earlier one they name, and whether an end names another begin than the innermost open one."""
    c = F.col
    ends = {"wait_end": "wait_depth"} | ({} if form is CPYTHON else {"release": "hold_depth"})
    begun = events.where(c("shape_ok") & (c("sequence") == c("events_before") + 1)).select(
        "capture_id",
        c("sequence").alias("named"),
        F.struct("line_no", "event_kind", "tid", "raw_lock_token", "lock_kind", "timestamp_ns", "result", "wait_depth", "hold_depth").alias("pair"),
    )
    # of the ends that name a begin the first one closes it; the step of an end took one off its depth
    naming = events.where(c("named").isNotNull())
    same = Window.partitionBy("capture_id", "named")
    naming = naming.withColumns({f"first_{end}": F.min(F.when(c("event_kind") == end, c("line_no"))).over(same) for end in ends})
    met = naming.join(begun, ["capture_id", "named"], "left")
    nested = F.lit(True)
    for end, depth in ends.items():
        nested = F.when(c("event_kind") == end, (c("pair")[depth] == c(depth) + 1) & (c(f"first_{end}") == c("line_no"))).otherwise(nested)
    met = met.withColumn("not_nested", ~F.coalesce(nested, F.lit(False)))
    return met.unionByName(events.where(c("named").isNull()).withColumn("not_nested", F.lit(True)), allowMissingColumns=True)


def _bad_pair(form: Form) -> Column:
    """An end that is not that of the innermost open begin, or whose times contradict it."""
    c = F.col
    kind, pair = c("event_kind"), c("pair")
    same = _all(pair["line_no"] < c("line_no"), pair["tid"] == c("tid"), pair["raw_lock_token"] == c("raw_lock_token"), pair["lock_kind"] == c("lock_kind"))
    since = c("timestamp_ns") - pair["timestamp_ns"]
    threshold = F.when(c("h.semantics") == "thresholded", c("h.duration_threshold_ns")).otherwise(F.lit(0))
    wait = _all(~c("not_nested"), same, pair["event_kind"] == "wait_begin", c("duration_ns") == since, c("duration_ns") >= threshold)
    taken = _all(same, pair["event_kind"] == "wait_end", pair["result"] == "acquired", since >= 0)
    if form is CPYTHON:
        return F.when(kind == "wait_end", ~wait).when(kind == "acquire", ~taken).otherwise(F.lit(False))
    hold = F.when(c("h.hold_time_is_source_observed"), _all(c("hold_duration_ns") == since)).otherwise(c("hold_duration_ns").isNull())
    release = _all(~c("not_nested"), same, pair["event_kind"] == "acquire", hold)
    return (
        F.when(kind == "wait_end", ~wait)
        .when((kind == "acquire") & c("related_source_event_id").isNotNull(), ~taken)
        .when(kind == "release", ~release)
        .otherwise(F.lit(False))
    )


def read_probe(lines: DataFrame, form: Form = NATIVE) -> ProbeFiles:
    """Judge the lines ``capture_id, line_no, line`` of whole probe files (``lines.numbered_lines`` numbers them).

    ``captures``: ``capture_id, accepted, reason, line_no`` (of the first bad line; null where the footer is
    missing), ``lines, stacks, events, threads``, and from the header and footer ``pid, semantics, threshold_ns,
    hold_observed, declared_events, lost_events, truncated``.  Empty files have no lines and so no row.
    """
    c = F.col
    records = _records(lines, form)
    headers = _headers(records)
    rows = _in_context(records, headers)
    first = c("lines_before") == 0
    ahead = (
        F.when(c("kind") == "broken", "INVALID_JSON")
        .when(first & (c("kind") != "header"), "HEADER_NOT_FIRST")
        .when(~first & (c("footers_before") > 0), "RECORD_AFTER_FOOTER")
        .when(~first & (c("kind") == "header"), "DUPLICATE_HEADER")
        .when(c("kind") == "other", "UNKNOWN_RECORD")
    )
    events = rows.where("kind = 'event'")
    with_pairs = _with_pairs(events, form)
    event_reason = (
        F.when(~c("shape_ok"), "INVALID_EVENT")
        .when(c("events_before") >= c("h.max_events"), "EVENT_BUDGET_EXCEEDED")
        .when(c("sequence") != c("events_before") + 1, "SEQUENCE_GAP")
        .when(c("pid") != c("h.pid"), "OUTSIDE_TARGET")
        .when(~F.array_contains("h.visible_lock_kinds", c("lock_kind")), "UNDECLARED_LOCK_KIND")
        .when((c("place_before") != c("lock_place")) & F.lit(form is not CPYTHON), "LOCK_KIND_CHANGED")
        .when(c("stack_id").isNotNull() & c("stack_line").isNull(), "UNKNOWN_STACK")
        .when((c("timestamp_ns") < c("time_before")) & F.lit(form is not CPYTHON), "TIME_REVERSED")
        .when(_bad_pair(form), "INVALID_EVENT_PAIR")
    )
    stack_reason = (
        F.when((c("events_before") > 0) & F.lit(form.stacks_first), "STACK_AFTER_EVENT")
        .when(~c("shape_ok"), "INVALID_STACK")
        .when(c("stack_id").isNotNull() & c("stack_line").isNotNull(), "DUPLICATE_STACK")
    )
    other_reason = (
        F.when((c("kind") == "header") & ~c("shape_ok"), "INVALID_HEADER")
        .when((c("kind") == "footer") & ~c("shape_ok"), "INVALID_FOOTER")
        .when((c("kind") == "footer") & (c("pid") != c("h.pid")), "OUTSIDE_TARGET")
        .when((c("kind") == "footer") & (c("sequence") != c("events_before") + form.footer_after), "SEQUENCE_GAP")
        .when((c("kind") == "footer") & (c("declared_event_count") != c("events_before")), "EVENT_COUNT_MISMATCH")
    )
    parts = [
        with_pairs.select("capture_id", "line_no", F.coalesce(ahead, event_reason).alias("reason")),
        rows.where("kind = 'stack'").select("capture_id", "line_no", F.coalesce(ahead, stack_reason).alias("reason")),
        rows.where("kind not in ('event', 'stack')").select("capture_id", "line_no", F.coalesce(ahead, other_reason).alias("reason")),
    ]
    problems = cut(reduce(DataFrame.unionByName, parts).where(c("reason").isNotNull()))
    return ProbeFiles(_captures(rows, headers, problems, form), problems, records.where("kind = 'stack'"), events)


def _captures(rows: DataFrame, headers: DataFrame, problems: DataFrame, form: Form) -> DataFrame:
    c = F.col
    is_end = c("kind") == "footer"
    counted = rows.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(c("kind") == "stack").alias("stacks"),
        F.count_if(c("kind") == "event").alias("events"),
        F.max(F.when(is_end, c("declared_event_count"))).alias("declared_events"),
        F.max(F.when(is_end, c("lost_event_count"))).alias("lost_events"),
        F.bool_or(F.when(is_end, c("truncated"))).alias("truncated"),
        F.bool_or(is_end).alias("ended"),
        F.sum(F.when(c("event_kind") == "wait_begin", 1).when(c("event_kind") == "wait_end", -1).otherwise(0)).alias("open_waits"),
    )
    threads = rows.where("kind = 'event'").select("capture_id", "tid").distinct().groupBy("capture_id").agg(F.count("tid").alias("threads"))
    worst = problems.groupBy("capture_id").agg(F.min(F.struct("line_no", "reason")).alias("first"))
    out = counted.join(threads, "capture_id", "left").join(worst, "capture_id", "left").join(headers, "capture_id", "left")
    reason = F.when(c("first").isNotNull(), c("first.reason")).when(~c("ended"), "MISSING_FOOTER")
    if form is CPYTHON:  # a whole exact file leaves no wait open
        reason = reason.when((c("h.semantics") == "exact") & ~c("truncated") & (c("open_waits") > 0), "OPEN_WAIT_AT_END")
    return out.select(
        "capture_id", reason.isNull().alias("accepted"), reason.alias("reason"), c("first.line_no").alias("line_no"), "lines", "stacks", "events",
        F.coalesce("threads", F.lit(0)).alias("threads"), c("h.pid").alias("pid"), c("h.semantics").alias("semantics"),
        c("h.duration_threshold_ns").alias("threshold_ns"), c("h.hold_time_is_source_observed").alias("hold_observed"), "declared_events", "lost_events", "truncated",
    )


def accepted_events(files: ProbeFiles, form: Form = NATIVE) -> DataFrame:
    """Events of the accepted files as raw events of the runtime-lock reader."""
    c = F.col
    whole = files.captures.where("accepted").select("capture_id", c("hold_observed").alias("__held"))
    rows = files.events.join(whole, "capture_id")
    kind, related = c("event_kind"), c("related_source_event_id")
    held = (kind == "release") & F.coalesce("__held", F.lit(False))
    pairs = {} if form is CPYTHON else {"acquire_source_event_id": F.when(held, related), "hold_duration_ns": F.when(held, c("hold_duration_ns"))}
    return _raw(
        rows,
        source_event_id=c("source_event_id"),
        event_kind=kind,
        ts_ns=c("timestamp_ns"),
        context=_thread(c("pid"), c("tid")),
        source_lock_id=c("raw_lock_token"),
        lock_kind=c("lock_kind"),
        source_stack_id=c("stack_id"),
        wait_begin_source_event_id=F.when(kind == "wait_end", related),
        duration_ns=F.when(kind == "wait_end", c("duration_ns")),
        outcome=F.when(kind == "wait_end", c("result")),
        wait_end_source_event_id=F.when(kind == "acquire", related),
        **pairs,
    )


def accepted_stacks(files: ProbeFiles) -> DataFrame:
    """Frames of the stacks of the accepted files, the outermost at depth 0."""
    rows = files.stacks.join(files.captures.where("accepted").select("capture_id"), "capture_id", "left_semi")
    return rows.select("capture_id", "stack_id", F.posexplode("frames").alias("depth", "f")).select("capture_id", "stack_id", "depth", "f.*")
