"""Captures derived from the given tables: the same SELECT for Spark and for DuckDB.

The tables hold no profiles, so these views give the operators rows of the right shape whose
number grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.ordered import cut_texts, dense_index
from gristmill.sources.folded import plain_frame

STACK_SQL = """
select case when l_shipdate < TIMESTAMP '2000-01-01 00:00:00' then 'baseline' else 'candidate' end as capture_id,
  l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_suppkey as thread_id, cast(l_quantity as bigint) as weight,
  case l_returnflag when 'A' then 'user' when 'N' then 'kernel' else 'unknown' end as sample_context,
  concat_ws(';', r_name, n_name, c_mktsegment, p_type, case when l_linenumber % 3 = 0 then p_type end, p_name) as stack,
  p_brand as leaf_dso
from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey
  join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
  join region on r_regionkey = n_regionkey
"""

EVENT_ROWS_SQL = """
select user_id, event_id, event_type, value, {EPOCH_US} * 1000 as ts_ns, cast({K} as int) as k from events
"""

SPARK_EPOCH = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
DUCK_EPOCH = "epoch_us(ts)"
SPARK_K = "get_json_object(props, '$.k')"
DUCK_K = "json_extract_string(props, '$.k')"

# one hour of nanoseconds: the bucket inside which rows of one capture are numbered
_NUMBERING_NS = 3_600_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem: capture, thread, weight, context, ``;``-joined stack, leaf object."""
    # the many lineitems are dealt by order while they are narrow, and once more by part; customers meet orders before
    # that, and the names of nations and regions come last, as these tables never grow
    lineitem, orders, customer, part, nation, region = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part", "nation", "region"))
    buyers = orders.join(customer, F.expr("c_custkey = o_custkey")).select("o_orderkey", "c_nationkey", "c_mktsegment")
    joined = lineitem.join(buyers, F.expr("o_orderkey = l_orderkey")).join(part, F.expr("p_partkey = l_partkey"))
    joined = joined.join(nation, F.expr("n_nationkey = c_nationkey")).join(region, F.expr("r_regionkey = n_regionkey"))
    return spark.sql(STACK_SQL.split("from lineitem")[0] + "from {joined}", joined=joined)


def samples(spark: SparkSession, sf_dir: str, kept: bool = False) -> DataFrame:
    """Stack samples; only the leaf lies in ``leaf_dso``, the callers in ``unknown``.

    With ``kept`` the joined rows are written once, for queries that read them several times.
    """
    from gristmill.sources.lines import once

    joined = stack_rows(spark, sf_dir)
    rows = once(cut_texts(joined) if kept else joined, symbols=F.split("stack", ";"))
    callers = F.slice("symbols", 1, F.size("symbols") - 1)
    leaf, unknown = F.element_at("symbols", -1), F.lit("unknown")

    def key(symbol, dso):
        return F.struct(symbol.alias("symbol"), dso.alias("dso"))

    return rows.select(
        "capture_id",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_seq"),
        "thread_id",
        "weight",
        "sample_context",
        F.concat(
            F.transform(callers, lambda s: plain_frame(s)), F.array(plain_frame(leaf, F.col("leaf_dso")))
        ).alias("frames"),
        F.concat(F.transform(callers, lambda s: key(s, unknown)), F.array(key(leaf, F.col("leaf_dso")))).alias("path"),
        unknown.alias("event"),
        F.lit("sample_count").alias("weight_unit"),
        F.lit("folded_weight").alias("weight_source"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with nanosecond time and the integer ``k`` of its JSON, numbered per capture."""
    text = EVENT_ROWS_SQL.replace("{EPOCH_US}", SPARK_EPOCH).replace("{K}", SPARK_K)
    rows = spark.sql(text.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    rows = rows.withColumn("capture_id", F.col("user_id") % 5)
    return dense_index(
        rows, ["capture_id"], ["ts_ns", "event_id"], F.floor(F.col("ts_ns") / F.lit(_NUMBERING_NS))
    )


def _kinds(mapping: dict[str, str], default: str):
    column = None
    for source, kind in mapping.items():
        condition = F.col("event_type") == source
        column = F.when(condition, kind) if column is None else column.when(condition, kind)
    return column.otherwise(default)


# fixed values: what each event type of the table stands for
SCHED_KINDS = {"click": "switch_in", "view": "switch_out", "signup": "wakeup", "purchase": "waking"}
LOCK_KINDS = {"click": "lock_wait", "view": "acquired", "purchase": "released", "error": "timed_out"}


def sched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduler events: one thread per user, with plenty of duplicates and gaps."""
    rows = event_rows(spark, sf_dir)
    return rows.select(
        "capture_id",
        F.col("user_id").alias("tid"),
        "event_index",
        "event_id",
        "ts_ns",
        (F.col("k") % 8).alias("cpu"),
        _kinds(SCHED_KINDS, "migrate").alias("event_type"),
        F.when(F.col("k") % 3 == 0, "S").when(F.col("k") % 3 == 1, "R").otherwise("D").alias("state"),
    )


def lock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock events of (thread, lock) streams."""
    rows = event_rows(spark, sf_dir)
    return rows.select(
        "capture_id",
        (F.col("user_id") % 10).alias("tid"),
        (F.col("k") % 3).cast("string").alias("lock_id"),
        "event_index",
        "event_id",
        "ts_ns",
        _kinds(LOCK_KINDS, "futex_wait").alias("event_type"),
        (F.col("k") % 4).alias("path_no"),
        F.when(F.col("k") % 7 == 0, F.lit("foreign_redacted"))
        .when(F.col("k") % 5 == 0, F.lit("target"))
        .otherwise(F.lit("unavailable"))
        .alias("owner_evidence"),
    )


DUCK_SAMPLES = f"samples as ({STACK_SQL})"
DUCK_EVENT_ROWS = (
    "event_rows as (select *, user_id % 5 as capture_id, row_number() over "
    "(partition by user_id % 5 order by ts_ns, event_id) - 1 as event_index from ("
    + EVENT_ROWS_SQL.replace("{EPOCH_US}", DUCK_EPOCH).replace("{K}", DUCK_K)
    + ") r)"
)
DUCK_SCHED = (
    DUCK_EVENT_ROWS
    + """, sched as (select capture_id, user_id as tid, event_index, event_id, ts_ns, k % 8 as cpu,
  case event_type when 'click' then 'switch_in' when 'view' then 'switch_out' when 'signup' then 'wakeup'
    when 'purchase' then 'waking' else 'migrate' end as event_type,
  case when k % 3 = 0 then 'S' when k % 3 = 1 then 'R' else 'D' end as state from event_rows)"""
)
DUCK_LOCKS = (
    DUCK_EVENT_ROWS
    + """, locks as (select capture_id, user_id % 10 as tid, cast(k % 3 as varchar) as lock_id, event_index,
  event_id, ts_ns,
  case event_type when 'click' then 'lock_wait' when 'view' then 'acquired' when 'purchase' then 'released'
    when 'error' then 'timed_out' else 'futex_wait' end as event_type, k % 4 as path_no,
  case when k % 7 = 0 then 'foreign_redacted' when k % 5 = 0 then 'target' else 'unavailable' end as owner_evidence
  from event_rows)"""
)


# fixed values: semantics of each capture, and what each event type of the table stands for
RUNTIME_SEMANTICS = "case capture_id when 3 then 'thresholded' when 4 then 'sampled' else 'exact' end"
RUNTIME_KINDS = """case when capture_id = 4 then 'sampled_contention' when event_type = 'click' then 'wait_begin'
  when event_type = 'view' then 'acquire' when event_type = 'purchase' then 'release'
  when event_type = 'error' then 'wait_end' when k % 2 = 0 then 'park' else 'unpark' end"""
_RUNTIME_COLUMNS = f"""capture_id, event_index, event_id, ts_ns, cast(user_id % 10 as {{text}}) as context,
  {RUNTIME_KINDS} as event_kind, {RUNTIME_SEMANTICS} as semantics,
  case when k % 11 = 0 and capture_id >= 3 then null else cast(k % 3 as {{text}}) end as lock_id,
  case when k % 3 = 2 then 'monitor' else 'mutex' end as lock_kind,
  case when k % 4 = 0 then null else 's' || cast(k % 6 as {{text}}) end as stack_id,
  case when k % 5 = 0 then cast(k % 10 as {{text}}) end as owner_context, k"""


def runtime_lock_events(spark: SparkSession, sf_dir: str, references: bool = False) -> DataFrame:
    """Runtime-lock events; durations are those a source would report, wrong in every 7th row.

    With ``references`` the ends name the open begin of their subject, or another row in every 9th
    row; recursive mutexes take part.
    """
    from gristmill.operators.ordered import count_since, running, running_last

    rows = spark.sql(
        "select " + _RUNTIME_COLUMNS.replace("{text}", "string") + " from {rows}", rows=event_rows(spark, sf_dir)
    )
    if references:
        rows = rows.withColumn(
            "lock_kind", F.when(F.col("lock_id") == "1", "recursive_mutex").otherwise(F.col("lock_kind"))
        )
    kind = F.col("event_kind")
    keyed = rows.withColumn("lock_key", F.coalesce("lock_id", F.lit("")))
    seen = running(
        keyed,
        ["capture_id", "context", "lock_key", "lock_kind"],
        "event_index",
        {
            "begin": running_last(F.when(kind == "wait_begin", F.struct("ts_ns", "event_id")), inclusive=False),
            "taken": running_last(F.when(kind == "acquire", F.struct("ts_ns", "event_id")), inclusive=False),
            "ended": running_last(F.when(kind == "wait_end", F.struct("ts_ns", "event_id")), inclusive=False),
            "begins": count_since(kind == "wait_begin", kind.isin("wait_end", "acquire"), inclusive=False),
            "takes": count_since(kind == "acquire", kind == "release", inclusive=False),
            "ends": count_since(kind == "wait_end", kind == "acquire", inclusive=False),
        },
    )
    off = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    out = (
        seen.withColumn(
            "duration_ns",
            F.when(kind == "wait_end", F.coalesce(F.col("ts_ns") - F.col("begin.ts_ns"), F.lit(1000)) + off),
        )
        .withColumn(
            "hold_duration_ns", F.when(kind == "release", F.col("ts_ns") - F.col("taken.ts_ns") + off)
        )
        .withColumn(
            "outcome",
            F.when(kind == "wait_end", F.when(F.col("k") % 4 == 0, "acquired").otherwise("timed_out")),
        )
        .withColumn("parked_context", F.when((kind == "unpark") & (F.col("k") % 13 != 1), F.col("context")))
        .withColumn("observed_count", F.when(kind == "sampled_contention", F.col("k").cast("bigint") + 1))
        .withColumn("cumulative_wait_ns", F.when(kind == "sampled_contention", F.col("ts_ns") % 1000000 + 1))
        .withColumn("estimated_count", F.lit(None).cast("double"))
    )
    if references:
        wrong = F.col("event_id") % 9 == 0
        other = (F.col("event_id") - 40).cast("string")

        def named(which: str, last: str, count: str):
            return F.when(
                (kind == which) & (F.col(count) % 2 == 1), F.when(wrong, other).otherwise(F.col(f"{last}.event_id").cast("string"))
            )

        out = (
            out.withColumn("wait_begin_event_id", named("wait_end", "begin", "begins"))
            .withColumn("wait_end_event_id", named("acquire", "ended", "ends"))
            .withColumn("acquire_event_id", named("release", "taken", "takes"))
        )
    return out.drop("begin", "taken", "ended", "begins", "takes", "ends", "lock_key", "k")


DUCK_RUNTIME = (
    DUCK_EVENT_ROWS
    + f""", rt0 as (select {_RUNTIME_COLUMNS.replace('{text}', 'varchar')} from event_rows),
rt1 as (select *, coalesce(lock_id, '') as lock_key,
    last_value(case when event_kind = 'wait_begin' then ts_ns end ignore nulls) over w as b_ts,
    last_value(case when event_kind = 'wait_begin' then event_id end ignore nulls) over w as b_id,
    last_value(case when event_kind = 'acquire' then ts_ns end ignore nulls) over w as a_ts,
    last_value(case when event_kind = 'acquire' then event_id end ignore nulls) over w as a_id from rt0
  window w as (partition by capture_id, context, coalesce(lock_id, ''), lock_kind order by event_index
    rows between unbounded preceding and 1 preceding)),
rt as (select *, case when event_kind = 'wait_end' then coalesce(ts_ns - b_ts, 1000) + case when event_id % 7 = 0 then 1 else 0 end end as duration_ns,
  case when event_kind = 'release' then ts_ns - a_ts + case when event_id % 7 = 0 then 1 else 0 end end as hold_duration_ns,
  case when event_kind = 'wait_end' then case when k % 4 = 0 then 'acquired' else 'timed_out' end end as outcome,
  case when event_kind = 'unpark' and k % 13 <> 1 then context end as parked_context,
  case when event_kind = 'sampled_contention' then k + 1 end as observed_count,
  case when event_kind = 'sampled_contention' then ts_ns % 1000000 + 1 end as cumulative_wait_ns from rt1)"""
)

# the same with references: recursive mutexes take part, ends name the open begin of their subject or the row 40 ids before
DUCK_REFERENCED = (
    DUCK_RUNTIME.replace(
        "rt1 as (select *,", "rt1 as (select * replace (case when lock_id = '1' then 'recursive_mutex' else lock_kind end as lock_kind),"
    )
    + """, rc as (select *, count(*) filter (event_kind in ('wait_end', 'acquire')) over w as c_wait, count(*) filter (event_kind = 'release') over w as c_hold,
    count(*) filter (event_kind = 'acquire') over w as c_take, last_value(case when event_kind = 'wait_end' then event_id end ignore nulls) over w as e_id
  from rt window w as (partition by capture_id, context, lock_key, lock_kind order by event_index rows between unbounded preceding and 1 preceding)),
rn as (select *,
    count(*) filter (event_kind = 'wait_begin') over (partition by capture_id, context, lock_key, lock_kind, c_wait order by event_index rows between unbounded preceding and 1 preceding) as begins,
    count(*) filter (event_kind = 'acquire') over (partition by capture_id, context, lock_key, lock_kind, c_hold order by event_index rows between unbounded preceding and 1 preceding) as takes,
    count(*) filter (event_kind = 'wait_end') over (partition by capture_id, context, lock_key, lock_kind, c_take order by event_index rows between unbounded preceding and 1 preceding) as ends
  from rc),
referenced as (select capture_id, event_index, cast(event_id as varchar) as event_id, ts_ns, context, event_kind, semantics, lock_key, lock_kind,
    duration_ns, hold_duration_ns, outcome, cast(case
      when event_kind = 'wait_end' and begins % 2 = 1 then case when event_id % 9 = 0 then event_id - 40 else b_id end
      when event_kind = 'acquire' and ends % 2 = 1 then case when event_id % 9 = 0 then event_id - 40 else e_id end
      when event_kind = 'release' and takes % 2 = 1 then case when event_id % 9 = 0 then event_id - 40 else a_id end end as varchar) as ref_id from rn)"""
)
