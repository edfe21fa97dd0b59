"""Probe files written from the events table, each damaged in one way or none, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.plans import views
from gristmill.plans.registry import query
from gristmill.sources import probe_files as P

# Every user is a file.  Each of its n events becomes four lines (wait_begin, wait_end, acquire, release), behind a
# header and three stacks.  Event number k stands in line 4 + k.  The damage depends on the user; it sits at the
# middle event m = 4 * (n // 2) + 2 (a wait_end).
_DAMAGE = ["none", "no_footer", "event_lost", "stack_after_event", "stack_twice", "foreign_pid", "wrong_duration", "unknown_record", "no_json", "time_back", "two_headers", "lock_kind", "no_such_stack", "wrong_count"]
_FILES = f"""select user_id, count(*) as n, 4 * (count(*) div 2) + 2 as m, cast(user_id % {len(_DAMAGE)} as int) as damage from {{events}} group by user_id"""


def _expected(form: P.Form) -> str:
    """Verdicts worked out from the damage alone."""
    native = form is P.NATIVE
    late_stack = "STACK_AFTER_EVENT" if native else None
    bad = {
        1: ("'MISSING_FOOTER'", "null"),
        2: ("'SEQUENCE_GAP'", "4 + m"),
        3: (f"'{late_stack}'", "5 + m") if native else ("'DUPLICATE_STACK'", "5 + m"),
        4: ("'DUPLICATE_STACK'", "5"),
        5: ("'OUTSIDE_TARGET'", "4 + m"),
        6: ("'INVALID_EVENT_PAIR'", "4 + m"),
        7: ("'UNKNOWN_RECORD'", "5 + m"),
        8: ("'INVALID_JSON'", "5 + m"),
        9: ("'TIME_REVERSED'", "4 + m") if native else ("'INVALID_EVENT_PAIR'", "4 + m"),
        10: ("'DUPLICATE_HEADER'", "2"),
        11: ("'LOCK_KIND_CHANGED'", "4 + m") if native else ("'INVALID_EVENT_PAIR'", "4 + m"),
        12: ("'UNKNOWN_STACK'", "4 + m"),
        13: ("'EVENT_COUNT_MISMATCH'", "5 + 4 * n"),
    }
    reason = "case damage " + " ".join(f"when {d} then {r}" for d, (r, _) in bad.items()) + " end"
    line = "case damage " + " ".join(f"when {d} then {at}" for d, (_, at) in bad.items()) + " end"
    more = "case damage when 1 then -1 when 2 then -1 when 3 then 1 when 4 then 1 when 7 then 1 when 8 then 1 when 10 then 1 else 0 end"
    return f"""with f as ({_FILES.format(events='events').replace('div', '//')}),
t as (select user_id, count(distinct event_id % 3) as threads from events group by user_id)
select user_id as capture_id, damage = 0 as accepted, {reason} as reason, cast({line} as bigint) as line_no, 5 + 4 * n + {more} as lines,
  3 + case when damage in (3, 4) then 1 else 0 end as stacks, 4 * n - case when damage = 2 then 1 else 0 end as events, threads,
  case when damage <> 1 then 4 * n + case when damage = 13 then 1 else 0 end end as declared_events, case when damage <> 1 then n % 3 end as lost_events
from f join t using (user_id)"""


def probe_lines(spark, sf_dir, form: P.Form):
    """The lines of all files."""
    native = form is P.NATIVE
    events = views.table(spark, sf_dir, "events")
    files = spark.sql(_FILES, events=events)
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    number = lambda c: c.cast("string")
    rows = events.select("user_id", "event_id", F.expr(views.SPARK_EPOCH).alias("ts_us"))
    from gristmill.operators.ordered import dense_index

    rows = dense_index(rows, ["user_id"], ["ts_us", "event_id"], F.floor(F.col("ts_us") / F.lit(3_600_000_000)), "i").join(files, "user_id")
    # four lines per event; times rise by ten
    kinds = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(k).alias("kind")) for j, k in enumerate(P.EVENT_KINDS)])
    rows = rows.select("*", F.explode(kinds).alias("x")).select("*", "x.j", "x.kind")
    seq = F.col("i") * 4 + F.col("j") + 1
    kind, damage, hit = F.col("kind"), F.col("damage"), seq == F.col("m")
    at = seq * 10 + 1000 - F.when(hit & (damage == 9), 500).otherwise(0)
    token = (F.col("event_id") % 4 + 1).cast("int")
    lock_kind = F.when(hit & (damage == 11), "condition").otherwise("mutex")
    related = F.when(kind == "wait_end", seq - 1).when(kind == "acquire", seq - 1)
    if native:
        related = related.when(kind == "release", seq - 1)
    quoted = lambda c: F.when(c.isNull(), "null").otherwise(text('"', c, '"'))
    held = text(',"hold_duration_ns":', F.when(kind == "release", "10").otherwise("null")) if native else F.lit("")
    stack = text(form_stack(form), number(F.when(hit & (damage == 12), 9).otherwise(F.col("event_id") % 3 + 1)))
    line = text(
        f'{{"schema_version":"1.0","record_type":"{form.prefix}_event","sequence":', number(seq), f',"source_event_id":"{form.id_prefix}', number(seq),
        '","event_kind":"', kind, '","timestamp_ns":', number(at), ',"pid":', F.when(hit & (damage == 5), "71").otherwise("70"), ',"tid":', number(70 + F.col("event_id") % 3),
        ',"raw_lock_token":"', F.format_string("%016x", token) if native else text("lock-", number(token)), '","lock_kind":"', lock_kind, '","related_source_event_id":',
        quoted(text(form.id_prefix, number(related))), ',"duration_ns":', F.when(kind == "wait_end", F.when(hit & (damage == 6), "11").otherwise("10")).otherwise("null"),
        held, ',"result":"', F.when(kind == "wait_begin", "unknown").when(kind == "release", "released").otherwise("acquired"), '","stack_id":"', stack, '"}',
    )
    # lines put in ahead of the events, and those put in or left out at the middle event
    ahead = F.when(damage.isin(4, 10), 1).otherwise(0)
    middle = F.when(damage == 2, -1).when(damage.isin(3, 7, 8), 1).otherwise(0)
    place = seq + 4 + ahead + F.when(seq > F.col("m"), middle).otherwise(0)
    lines = rows.where(~(hit & (damage == 2))).select("user_id", place.alias("line_no"), line.alias("line"))
    kinds_text = ",".join(f'"{k}"' for k in (("condition", "mutex") if native else form.lock_kinds))
    header = f'{{"schema_version":"1.0","record_type":"{form.prefix}_header","protocol":"{form.protocol}","protocol_version":"1.0","pid":70,"uid":0,"target_start_time_ticks":5,"semantics":"exact","duration_threshold_ns":null,"max_events":20000,"visible_lock_kinds":[{kinds_text}],'
    header += (
        '"runtime":"c_cpp","runtime_version":"1","adapter_id":"native-pthread","adapter_version":"1","backend_id":"ld-preload","backend_version":"1","observed_target_tids":[70,71,72],"target_kind":"host","container_reference":null,"fast_path_visibility":"complete","owner_is_source_observed":false,"hold_time_is_source_observed":true}'
        if native
        else '"runtime_version":"3.13.1","free_threaded":false}'
    )
    frame = '{"symbol":"f%s","module":"%s","source_file":"/a.c","source_line":%s,"is_runtime":false,"is_unknown":false}'
    one_stack = lambda n: f'{{"schema_version":"1.0","record_type":"{form.prefix}_stack","stack_id":"{form_stack(form)}{n}","frames":[{",".join(frame % (d, "python" if not native else "m", d + 1) for d in range(n))}]}}'
    total = F.col("n") * 4
    footer = text(
        f'{{"schema_version":"1.0","record_type":"{form.prefix}_footer","protocol":"{form.protocol}","pid":70,"sequence":',
        number(total + form.footer_after - F.when(F.col("damage") == 2, 1).otherwise(0)), ',"declared_event_count":', number(total + F.when(F.col("damage") == 13, 1).otherwise(0)),
        ',"lost_event_count":', number(F.col("n") % 3), ',"truncated":false', "" if native else ',"observed_target_tids":[70,71,72]', "}",
    )

    extra = lambda condition, at, value: F.when(condition, F.struct(at.cast("long").alias("line_no"), value.alias("line")))
    d, broken = F.col("damage"), F.col("m") + 5
    others = F.array(
        extra(F.lit(True), F.lit(1), F.lit(header)),
        *[extra(F.lit(True), n + 1 + F.when(d == 10, 1).otherwise(0), F.lit(one_stack(n))) for n in (1, 2, 3)],
        extra(d != 1, total + 5 + ahead + middle, footer),
        extra(d == 10, F.lit(2), F.lit(header)),
        extra(d == 4, F.lit(5), F.lit(one_stack(2))),
        extra(d == 3, broken, F.lit(one_stack(1))),
        extra(d == 7, broken, F.lit('{"record_type":"probe_other"}')),
        extra(d == 8, broken, F.lit('{"record_type":"probe_ev')),
    )
    more = files.select("user_id", F.inline(F.array_compact(others)))
    return lines.unionByName(more).select(F.col("user_id").alias("capture_id"), "line_no", "line")


def form_stack(form: P.Form) -> str:
    return "s" if form is P.NATIVE else "stack-"


_COLUMNS = ["capture_id", "accepted", "reason", "line_no", "lines", "stacks", "events", "threads", "declared_events", "lost_events"]


@query("probe_files", _expected(P.NATIVE))
def probe_files(spark, sf_dir):
    return P.read_probe(probe_lines(spark, sf_dir, P.NATIVE)).captures.select(_COLUMNS)


@query("cpython_files", _expected(P.CPYTHON))
def cpython_files(spark, sf_dir):
    return P.read_probe(probe_lines(spark, sf_dir, P.CPYTHON), P.CPYTHON).captures.select(_COLUMNS)


@query(
    "probe_events",
    f"""with f as ({_FILES.format(events='events').replace('div', '//')}), e as (select user_id, event_id % 3 as t, event_id % 4 as l, event_id % 3 + 1 as s, count(*) as c from events join f using (user_id) where damage = 0 group by all)
select user_id as capture_id, 'os_thread|70|' || (70 + t) || '|' as context, printf('%016x', l + 1) as lock_id, 's' || s as stack_id, 4 * c as events, 10 * c as waited_ns, 10 * c as held_ns,
  c as named_begins, c as named_waits, c as named_acquires, s as depth from e""",
)
def probe_events(spark, sf_dir):
    """Events and stacks of the files that were accepted."""
    files = P.read_probe(probe_lines(spark, sf_dir, P.NATIVE))
    rows = P.accepted_events(files)
    depth = P.accepted_stacks(files).groupBy("capture_id", F.col("stack_id").alias("source_stack_id")).agg(F.count(F.lit(1)).alias("depth"))
    per = rows.groupBy("capture_id", "context", "source_lock_id", "source_stack_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("duration_ns").alias("waited_ns"), F.sum("hold_duration_ns").alias("held_ns"),
        F.count("wait_begin_source_event_id").alias("named_begins"), F.count("wait_end_source_event_id").alias("named_waits"), F.count("acquire_source_event_id").alias("named_acquires"),
    )
    return per.join(depth, ["capture_id", "source_stack_id"], "left").withColumnsRenamed({"source_lock_id": "lock_id", "source_stack_id": "stack_id"})
