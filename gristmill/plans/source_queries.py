"""Queries that build source text from the tables and parse it back.

The text is made by one SELECT for Spark and for DuckDB; the twins compute the wanted values from the
columns the text was made of, never by parsing it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill import sinks
from gristmill.functions import redact as X
from gristmill.functions import trace_codes as C
from gristmill.operators import bench as OB
from gristmill.operators import hotspots as H
from gristmill.operators import quality as Q
from gristmill.plans import views
from gristmill.plans.compare_queries import _DUCK_FRAMES
from gristmill.plans.registry import query
from gristmill.sources import adapters as A
from gristmill.sources import bench as B
from gristmill.sources import cgroup as G
from gristmill.sources import perf_script as P
from gristmill.sources import rule_tables as RT
from gristmill.sources import trace_text as T


def _select(spark, sf_dir, text, table):
    """The SELECT in Spark's dialect, its FROM left open."""
    return spark.sql(text.replace("varchar", "string") + " from {rows}", rows=views.table(spark, sf_dir, table))


_PLACES = """select l_orderkey, l_linenumber, case when l_partkey % 9 = 0 then '??:0' when l_partkey % 9 = 1 then '/src/plain.c'
  else concat('/src/p', cast(l_partkey as varchar), '.c:', cast(l_linenumber - 1 as varchar),
    case when l_suppkey % 2 = 0 then concat(':', cast(l_suppkey % 3 as varchar)) else '' end) end as place, l_partkey, l_suppkey"""


@query(
    "source_places",
    f"""with p as ({_PLACES} from lineitem), q as (select *, l_partkey % 9 = 0 as hidden, l_partkey % 9 = 1 as plain, l_linenumber > 1 as lined from p)
select l_orderkey, l_linenumber, case when hidden then null when plain then '/src/plain.c' else '/src/p' || l_partkey || '.c' end as source_file,
  case when not hidden and not plain and lined then l_linenumber - 1 end as source_line,
  case when not hidden and not plain and lined and l_suppkey % 2 = 0 and l_suppkey % 3 > 0 then cast(l_suppkey % 3 as int) end as source_column from q""",
)
def source_places(spark, sf_dir):
    rows = _select(spark, sf_dir, _PLACES, "lineitem")
    parsed = P.parse_source(F.col("place"))
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in parsed.items()])


_ADDRESSES = """select event_id, concat(case when event_id % 2 = 0 then '0x' else '' end, '000', case when event_id % 3 = 0 then upper({hex}) else lower({hex}) end) as ip,
  case event_id % 4 when 0 then 'Ux' when 1 then 'k' when 2 then 'h' else '' end as misc"""


@query(
    "frame_addresses",
    """select event_id, printf('%x', event_id * 40503) as address, case event_id % 4 when 0 then 'user' when 1 then 'kernel' else 'unknown' end as privilege
from events""",
)
def frame_addresses(spark, sf_dir):
    rows = _select(spark, sf_dir, _ADDRESSES.format(hex="hex(event_id * 40503)"), "events")
    return rows.select(
        "event_id", P.normalized_ip(F.col("ip")).alias("address"), P.sample_context(F.col("misc")).alias("privilege")
    )


@query(
    "trace_codes",
    """with e as (select event_id, event_id % 300 as op, substr('RSDTtXxZPIq', cast(event_id % 11 as int) + 1, 1) as letter from events)
select event_id, op & 127 as command, case when (op & 127) in (0, 9, 11) then 'futex_wait' when (op & 127) in (1, 3, 10) then 'futex_wake' end as kind,
  case letter when 'R' then 'running' when 'S' then 'interruptible_sleep' when 'D' then 'uninterruptible_sleep' when 'T' then 'stopped' when 't' then 'traced'
    when 'Z' then 'dead' when 'X' then 'dead' when 'x' then 'dead' when 'P' then 'parked' when 'I' then 'idle' else 'unknown' end as state,
  -op as negated, 'event-' || substr(sha256('7:' || event_id || ':' || letter), 1, 24) as pseudonym from e""",
)
def trace_codes(spark, sf_dir):
    text = """select event_id, concat('0x', lower(hex(event_id % 300))) as op, concat('-0x', hex(event_id % 300)) as minus,
      substr('RSDTtXxZPIq', cast(event_id % 11 as int) + 1, 1) as letter"""
    rows = _select(spark, sf_dir, text, "events").withColumn("value", C.parse_integer(F.col("op")))
    return rows.select(
        "event_id",
        F.col("value").bitwiseAND(C.FUTEX_MASK).alias("command"),
        C.futex_kind(F.col("value")).alias("kind"),
        C.state_from_letter(F.concat("letter", F.when(F.col("event_id") % 5 == 0, "+").otherwise(""))).alias("state"),
        C.parse_integer(F.col("minus")).alias("negated"),
        C.event_id(F.lit(7), F.col("event_id"), F.col("letter")).alias("pseudonym"),
    )


@query(
    "jfr_times",
    """select event_id, epoch_us(ts) * 1000 - (event_id % 3) * 3600000000000 as start_ns,
  (event_id % 100) * 1000000000 + (event_id % 1000) * 1000000 as duration_ns from events""",
)
def jfr_times(spark, sf_dir):
    """Times with a zone of 0 to 2 hours and six fraction digits, durations with three."""
    zone = F.when(F.col("event_id") % 3 == 0, "Z").otherwise(F.concat(F.lit("+0"), (F.col("event_id") % 3).cast("string"), F.lit(":00")))
    rows = views.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone).alias("start"),
        F.format_string("PT%d.%03dS", F.col("event_id") % 100, F.col("event_id") % 1000).alias("lasted"),
    )
    return rows.select(
        "event_id", A.jfr_time_ns(F.col("start")).alias("start_ns"), A.jfr_duration_ns(F.col("lasted")).alias("duration_ns")
    )


@query(
    "source_mapping",
    """select page_id, case when page_id % 3 = 0 then 'work/' || page_id else 'sha256:' || sha256(url) end as source_file from pages""",
)
def source_mapping(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    places = pages.select("page_id", F.col("url").alias("source_file"), F.col("page_id").cast("int").alias("source_line"))
    known = pages.where("page_id % 3 = 0").select(
        X.path_digest(F.col("url")).alias("path_digest"),
        F.col("page_id").cast("int").alias("source_line"),
        F.concat(F.lit("work/"), F.col("page_id")).alias("workspace_path"),
    )
    return X.map_sources(places, known).select("page_id", "source_file")


@query(
    "content_digests",
    """select user_id, event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') as digest from events""",
)
def content_digests(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return rows.select("user_id", "event_id", X.content_digest(["user_id", "event_type", "event_id"]).alias("digest"))


@query(
    "event_lines",
    """select '{' || case when user_id % 4 > 0 then '"cpu":' || user_id % 4 || ',' else '' end || '"event_id":' || event_id || ',"event_index":' || event_id
  || ',"kind":"' || event_type || '","ts_ns":' || epoch_us(ts) * 1000 || '}' as line from events""",
)
def event_lines(spark, sf_dir):
    rows = views.event_rows(spark, sf_dir).select(
        "event_id", F.col("event_id").alias("event_index"), "ts_ns", F.col("event_type").alias("kind"),
        F.nullif(F.col("user_id") % 4, F.lit(0)).alias("cpu"),
    )
    ordered = rows.withColumn("capture_id", F.lit(None).cast("string"))
    return sinks.event_lines(ordered).select(F.col("value").alias("line"))


@query(
    "ledgers",
    f"""with e as (select user_id % 5 as capture_id, event_type as disposition, row_number() over (partition by user_id % 5 order by ts, event_id) - 1 as i,
  cast(event_id as varchar) as id from events),
s as (select capture_id, disposition, i // 65536 as span, sha256(unhex(string_agg(lpad(hex(length(id)), 16, '0') || hex(encode(id)), '' order by i))) as digest
  from e group by all),
d as (select capture_id, disposition, sha256(unhex(string_agg(digest, '' order by span))) as ids_sha256 from s group by all)
select e.capture_id, e.disposition, count(*) as total_count, array_to_string((list(e.id order by i))[1:3], ',') as first_ids, any_value(ids_sha256) as ids_sha256,
  count(*) > 3 as truncated from e join d on d.capture_id = e.capture_id and d.disposition = e.disposition group by all""",
)
def ledgers(spark, sf_dir):
    rows = views.event_rows(spark, sf_dir).select("capture_id", "event_index", "event_id", F.col("event_type").alias("disposition"))
    found = Q.ledger(rows, keep=3)
    return found.select(
        "capture_id", "disposition", "total_count", F.array_join("ids", ",").alias("first_ids"), "ids_sha256", "truncated"
    )


@query(
    "bench_documents",
    """select o_orderkey as capture_id, o_orderpriority as name, 3 as samples, o_totalprice + 1 as median, cast(o_orderkey % 2 as int) as error_count from orders""",
)
def bench_documents(spark, sf_dir):
    times = F.concat_ws(",", *[(F.col("o_totalprice") + n).cast("string") for n in (0, 1, 5)])
    text = '{"results":[{"command":"%s","times":[%s],"exit_codes":[0,%d,0]}]}'
    documents = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("capture_id"),
        F.format_string(text, "o_orderpriority", times, F.col("o_orderkey") % 2).alias("document"),
    )
    documents = B.with_dialect(documents)  # values and runs read them
    stats = OB.metric_stats(B.benchmark_values(documents), ["capture_id", "name"])
    errors = B.benchmark_runs(documents).select("capture_id", F.col("error_count").cast("int").alias("error_count"))
    return stats.join(errors, "capture_id").select("capture_id", "name", F.col("samples").cast("int").alias("samples"), "median", "error_count")


@query(
    "cgroup_text",
    """select event_id as capture_id, event_id * 3 as cpu_usage_usec, event_id % 7 as cpu_nr_throttled,
  case when event_id % 2 = 0 then event_id * 4096 end as memory_max_bytes, event_id % 11 as oom, event_id % 13 * 512 as read_bytes from events""",
)
def cgroup_text(spark, sf_dir):
    e = F.col("event_id")

    def text(pattern, *values):
        return F.format_string(pattern, *values)

    files = {
        "cpu.stat": text("usage_usec %d\nuser_usec 1\nsystem_usec 1\nnr_periods 9\nnr_throttled %d\nthrottled_usec 0\n", e * 3, e % 7),
        "cpu.max": F.lit("max 100000\n"), "cpuset.cpus.effective": F.lit("0-1\n"), "memory.current": F.lit("1\n"),
        "memory.max": F.when(e % 2 == 0, text("%d\n", e * 4096)).otherwise("max\n"),
        "memory.events": text("low 0\noom %d\n", e % 11), "memory.pressure": F.lit("some avg10=0.00 total=1\nfull avg10=0.00 total=1\n"),
        "io.stat": text("8:0 rbytes=%d wbytes=0 rios=1 wios=0 dbytes=0\n", e % 13 * 512), "io.max": F.lit(""),
        "io.pressure": F.lit("some avg10=0.00 total=3\n"), "pids.current": F.lit("1\n"), "pids.max": F.lit("max\n"),
    }
    rows = views.table(spark, sf_dir, "events").select(
        e.alias("capture_id"), F.lit(1).cast("long").alias("ts_ns"),
        F.create_map(*[x for name, value in files.items() for x in (F.lit(name), value)]).alias("files"),
    )
    parsed = G.parse_snapshots(rows).where(F.size("invalid") == 0)
    return parsed.select(
        "capture_id", "cpu_usage_usec", "cpu_nr_throttled", "memory_max_bytes", F.col("memory_events")["oom"].alias("oom"),
        F.get("io_devices", F.lit(0)).getField(_read_field(parsed)).alias("read_bytes"),
    )


def _read_field(parsed):
    """Name of the bytes read in a device struct."""
    return parsed.schema["io_devices"].dataType.elementType.fieldNames()[2]


# a line per event of the threads 0 to 9 of one process; even threads are the target's
_TRACE_TARGETS = [0, 2, 4, 6, 8]


@query(
    "transcript_lines",
    """with e as (select user_id % 5 as capture_id, event_type, user_id % 10 % 2 = 0 as target, row_number() over (partition by user_id % 5 order by ts, event_id) - 1 as i from events)
select capture_id, case when event_type = 'view' then 'malformed' when event_type = 'signup' then 'lost'
  when i % 37 = 36 then 'out_of_order' when event_type = 'error' then 'unsupported' when not target then 'foreign' else 'accepted' end as disposition, count(*) as lines from e group by all""",
)
def transcript_lines(spark, sf_dir):
    return transcript_lines_judged(spark, sf_dir).groupBy("capture_id", "disposition").agg(F.count(F.lit(1)).alias("lines"))


def transcript_lines_judged(spark, sf_dir):
    rows = views.event_rows(spark, sf_dir)
    kind, tid = F.col("event_type"), (F.col("user_id") % 10).cast("string")
    # times rise with the line; every 37th line steps back behind those before it
    late = F.col("event_index") % 37 == 36
    at = F.format_string("%d.%09d", F.col("event_index") + 100 - F.when(late, 40).otherwise(0), F.lit(0))
    head = F.concat(F.lit("70/"), tid, F.lit(" [001] "), at, F.lit(": "))
    migrate = F.concat(F.lit("sched:sched_migrate_task: comm=t pid="), tid, F.lit(" prio=1 orig_cpu=0 dest_cpu=1"))
    line = (
        F.when(kind == "view", "no transcript line")
        .when(kind == "signup", "PERF_RECORD_LOST lost 3")
        .otherwise(F.concat(head, F.when(kind == "error", "irq:irq_handler_entry: x").otherwise(migrate)))
    )
    lines = rows.select("capture_id", (F.col("event_index") + 1).alias("line_no"), line.alias("line"))
    targets = spark.range(5).select(
        F.col("id").alias("capture_id"), F.lit(70).alias("target_pid"), F.lit(_TRACE_TARGETS).cast("array<bigint>").alias("target_tids")
    )
    return T.judge_trace(T.parse_trace(lines), targets, "sched")


@query(
    "recomputed_hotspots",
    f"""with {_DUCK_FRAMES} select capture_id, symbol, dso, unnest(['exported', 'recomputed']) as side from exported where rank % 50 = 7""",
)
def recomputed_hotspots(spark, sf_dir):
    """Every 50th hotspot is given a wrong weight; just these must be told from the call paths."""
    samples = views.samples(spark, sf_dir, kept=True)
    spots = H.export_hotspots(H.hotspots(samples))
    damaged = spots.withColumn("self_weight", F.col("self_weight") + (F.col("rank") % 50 == 7).cast("bigint"))
    paths = H.export_call_paths(H.call_paths(samples))
    quality = samples.select("capture_id").distinct().withColumn("omitted_call_path_weight", F.lit(0))
    return Q.recomputed_hotspots_differ(damaged, paths, quality).select("capture_id", "symbol", "dso", "side")


# a rule file for every part, of two documents; the second is damaged by rule
@query(
    "rule_documents",
    """with p as (select p_partkey, p_size, p_brand, p_type, case p_partkey % 8 when 1 then 'missing_id' when 2 then 'missing_symbol_pattern' when 3 then 'invalid_pattern'
  when 4 then 'unknown_scope' when 5 then 'unknown_confidence' when 6 then 'missing_category' end as reason from part),
f as (select *, printf('%08d', p_partkey) as path from p)
select path, 0 as position, null as reason, 'first ' || p_partkey as rule_id, cast(p_size as double) as self_percent_gte, p_brand as symbol_pattern, '^' || p_type as dso_pattern from f
union all select path, 1, reason, case when reason is null then 'second ' || p_partkey end, case when reason is null then 0.0 end, case when reason is null then 'a[bc]' end, null from f""",
)
def rule_documents(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    damage = F.col("p_partkey") % 8

    def unless(n: int, text: str) -> F.Column:
        return F.when(damage == n, F.lit("null")).otherwise(F.lit(text))

    first = F.concat(
        F.lit('{"id":"first '), key, F.lit('","version":3,"scope":"linux","match":{"symbol_regex":["'), "p_brand", F.lit('"],"dso_regex":["^'), "p_type",
        F.lit('"]},"thresholds":{"self_percent_gte":'), F.col("p_size").cast("string"), F.lit('},"classification":{"category":"c","confidence":"medium"},"observation":"o"}'),
    )
    second = F.concat(
        F.lit('{"id":'), F.when(damage == 1, "null").otherwise(F.concat(F.lit('"second '), key, F.lit('"'))),
        F.lit(',"scope":'), unless(4, '"cpp"'), F.lit(',"match":{"symbol_regex":'), F.when(damage == 2, "[]").when(damage == 3, '["a", "(b"]').otherwise('["a[bc]"]'),
        F.lit('},"classification":{"category":'), unless(6, '"c"'), F.lit(',"confidence":'), F.when(damage == 5, '"certain"').otherwise('"low"'), F.lit("}}"),
    )
    files = part.select(F.format_string("%08d", "p_partkey").alias("path"), F.concat(F.lit(" ["), first, F.lit(",\n"), second, F.lit("]")).alias("text"))
    rules, rejects = RT.parse_rules(files)
    # rules are numbered by file and place; each file has one rule or two
    kept = rules.select(
        F.regexp_extract("rule_id", "[0-9]+", 0).cast("int").alias("n"), F.when(F.col("rule_id").startswith("first"), 0).otherwise(1).alias("position"),
        F.lit(None).cast("string").alias("reason"), "rule_id", "self_percent_gte", F.col("symbol_regex")[0].alias("symbol_pattern"), F.get("dso_regex", F.lit(0)).alias("dso_pattern"),
    )
    kept = kept.select(F.format_string("%08d", "n").alias("path"), *kept.columns[1:])
    return kept.unionByName(rejects, allowMissingColumns=True)
