"""Runtime-lock streams written from the events table, with one fault per row by rule, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators.ordered import cut, dense_index
from gristmill.plans import views
from gristmill.plans.registry import query
from gristmill.sources import runtime_ndjson as N

# what is wrong with an event, by its id modulo 17; the rest is right
_FAULTS = {
    1: "INVALID_JSON", 2: "UNSUPPORTED_RECORD", 3: "UNSUPPORTED_EVENT", 4: "INVALID_EVENT", 5: "SCHEMA_MISMATCH", 6: "OUTSIDE_TARGET_CONTEXT", 7: "INVALID_CONTEXT",
    8: "DUPLICATE_EVENT_ID", 9: "OUT_OF_ORDER_EVENT", 10: "UNDECLARED_LOCK_KIND", 11: "SEMANTICS_MISMATCH", 12: "UNKNOWN_STACK_ID", 13: "OWNER_VISIBILITY_MISMATCH", 14: "INVALID_EVENT_PAIR",
}
_REASON = "case event_id % 17 " + " ".join(f"when {n} then '{r}'" for n, r in _FAULTS.items()) + " else 'accepted' end"
_CLASSES = {
    "malformed": [n for n, r in _FAULTS.items() if r in N.MALFORMED], "unsupported": [n for n, r in _FAULTS.items() if r in N.UNSUPPORTED],
    "duplicate": [8], "out_of_order": [9], "filtered": [6],
}


def stream_lines(spark, sf_dir):
    """(capture_id, line_no, line): a header, stacks, one event that is right, and the events of a user in order of their ids."""
    events = views.table(spark, sf_dir, "events").select("user_id", "event_id")
    fault = F.col("event_id") % 17
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    number = F.col("event_id").cast("string")
    context = (
        F.when(fault == 6, '{"kind":"os_thread","target_pid":70,"target_tid":99}').when(fault == 7, '{"kind":"go_goroutine","target_pid":70,"runtime_context_id":"g1"}')
        .otherwise('{"kind":"os_thread","target_pid":70,"target_tid":71}')
    )
    kind = F.when(fault == 3, "spin").when(fault == 11, "sampled_contention").when(fault == 14, "wait_end").when(fault.isin(4, 13), "wait_begin").otherwise("park")
    line = text(
        '{"schema_version":"', F.when(fault == 5, "1.0").otherwise("1.1"), '","record_type":"', F.when(fault == 2, "runtime_lock_note").otherwise("runtime_lock_event"), '","source_event_id":"',
        F.when(fault == 8, "first").otherwise(text("e", number)), '","event_kind":"', kind, '","timestamp_ns":', F.when(fault == 9, "5").otherwise(text("1", F.lpad(number, 9, "0"))),
        ',"lock_kind":"', F.when(fault == 10, "rwlock").otherwise("mutex"), '"', F.when(fault == 4, "").otherwise(',"source_lock_id":"L1"'),
        F.when(fault == 12, ',"source_stack_id":"gone"').when(fault == 15, ',"source_stack_id":"s1"').otherwise(""),
        F.when(fault == 5, ',"target_tid":71').otherwise(text(',"execution_context":', context)), F.when(fault == 13, text(',"owner_execution_context":', context)).otherwise(""),
        F.when(fault == 11, ',"observed_count":2,"cumulative_wait_ns":9').when(fault == 14, ',"wait_begin_source_event_id":"gone","duration_ns":1,"outcome":"acquired"').otherwise(""),
        F.when(fault == 1, "").otherwise("}"),
    )
    rows = events.select("user_id", (F.col("event_id") + 10).alias("at"), line.alias("line"))
    users = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    head = text(
        '{"schema_version":"1.1","record_type":"runtime_lock_header","runtime":"python","adapter_id":"x","target":{"target_pid":70,"observed_target_tids":[70,71]},"measurement_semantics":"exact",',
        '"visible_lock_kinds":["mutex"],"owner_is_source_observed":false,"hold_time_is_source_observed":false,"declared_event_count":', (F.col("n") + 1).cast("string"),
        ',"declared_lost_event_count":', (F.col("user_id") % 3).cast("string"), ',"declared_truncated":false}',
    )
    stack = '{"schema_version":"1.1","record_type":"runtime_lock_stack","source_stack_id":"%s","frames":[%s]}'
    frame = '{"symbol":"f","module":"m","source_file":null,"source_line":null,"is_runtime":false,"is_unknown":false}'
    first = '{"schema_version":"1.1","record_type":"runtime_lock_event","source_event_id":"first","event_kind":"park","timestamp_ns":10,"lock_kind":"mutex","source_lock_id":"L1","execution_context":{"kind":"os_thread","target_pid":70,"target_tid":70}}'
    u = F.col("user_id")
    extra = [
        (F.lit(True), -9, head), (F.lit(True), -8, F.lit(stack % ("s1", frame))), (u % 2 == 0, -7, F.lit(stack % ("s1", frame))), (u % 3 == 0, -6, F.lit(stack % ("s2", ""))),
        (F.lit(True), -5, F.lit(first)), (u % 5 == 0, 1 << 40, F.lit(stack % ("s3", frame))),
    ]
    for condition, at, value in extra:
        rows = rows.unionByName(users.where(condition).select("user_id", F.lit(at).cast("long").alias("at"), value.alias("line")))
    numbered = dense_index(rows, ["user_id"], ["at"], F.floor(F.col("at") / F.lit(65536)), "n")
    return numbered.select(F.col("user_id").alias("capture_id"), (F.col("n") + 1).alias("line_no"), "line")


def _judged(spark, sf_dir):
    stream = N.parse_stream(stream_lines(spark, sf_dir))
    return stream, cut(N.accept_events(stream.events, stream.headers, stream.stacks))


@query(
    "rt_import_reasons",
    f"""select user_id as capture_id, reason, sum(n)::bigint as events from (select user_id, {_REASON} as reason, count(*) as n from events group by all
  union all select user_id, 'accepted', 1 from events group by user_id) group by all""",
)
def rt_import_reasons(spark, sf_dir):
    judged = _judged(spark, sf_dir)[1]
    return judged.groupBy("capture_id", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "rt_import_counters",
    "select user_id as capture_id, count(*) + 1 as declared_event_count, count(*) + 1 as input_events, cast(user_id % 3 as bigint) as lost, "
    + f"count(*) filter ({_REASON} = 'accepted') + 1 as emitted_events, "
    + ", ".join(f"count(*) filter (event_id % 17 in ({', '.join(map(str, ns))})) as {c}" for c, ns in _CLASSES.items())
    + """, cast(1 + (user_id % 2 = 0)::int + (user_id % 3 = 0)::int + (user_id % 5 = 0)::int as bigint) as input_stacks, cast(1 as bigint) as emitted_stacks,
  cast((user_id % 3 = 0)::int + (user_id % 5 = 0)::int as bigint) as malformed_stacks, cast((user_id % 2 = 0)::int as bigint) as duplicate_stacks from events group by user_id""",
)
def rt_import_counters(spark, sf_dir):
    stream, judged = _judged(spark, sf_dir)
    return N.import_counters(judged, stream.stacks, stream.headers).select(
        "capture_id", "declared_event_count", "input_events", "lost", "emitted_events", *_CLASSES, "input_stacks", "emitted_stacks", "malformed_stacks", "duplicate_stacks"
    )


@query(
    "rt_import_events",
    f"""with a as (select user_id, event_id from events where {_REASON} = 'accepted' union all select distinct user_id, -1 from events)
select user_id as capture_id, row_number() over (partition by user_id order by event_id) - 1 as event_index, case when event_id < 0 then 'first' else 'e' || event_id end as event_id,
  case when event_id < 0 then 10 else 1000000000 + event_id end as ts_ns, case when event_id < 0 then 'os_thread|70|70|' else 'os_thread|70|71|' end as context,
  case when event_id >= 0 and event_id % 17 = 15 then 's1' end as stack_id from a""",
)
def rt_import_events(spark, sf_dir):
    """Accepted events as the replay takes them, numbered anew."""
    rows = N.normalized_events(_judged(spark, sf_dir)[1])
    return rows.select("capture_id", "event_index", "event_id", "ts_ns", "context", "stack_id")
