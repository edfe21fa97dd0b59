"""Verdicts, diagnoses, device counters and report rows over cases made from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill import sinks
from gristmill.operators import classify as C
from gristmill.operators import compare as P
from gristmill.operators import pages as G
from gristmill.operators import resources as V
from gristmill.plans import views
from gristmill.plans.registry import query

_ROUND_FLAGS = ("fixed_environment_match", "profiles_comparable", "benchmarks_comparable", "containerized", "event_source_match")


@query(
    "optimization_verdict",
    """with p as (select p_partkey as k, p_size as s, p_partkey % 13 >= 5 as fixed, p_size % 3 > 0 as selected, case p_size % 4 when 0 then null when 1 then false else true end as lock_comparable,
  case p_partkey % 4 when 0 then 'candidate_regression' when 1 then 'not_comparable' when 2 then 'candidate_improvement' end as lock_conclusion, p_partkey % 5 = 0 as worse, p_partkey % 3 < 2 as better from part),
q as (select *, case when not selected then 'not_selected' when lock_comparable is null then 'unavailable' when k % 6 > 0 and k % 9 > 0 and lock_comparable then 'complete' else 'partial' end as status,
  fixed and (not selected or coalesce(lock_comparable, false)) as comparable from p),
v as (select *, k % 7 > 0 and k % 11 > 0 and status in ('not_selected', 'complete') and coalesce(lock_conclusion, '') not in ('candidate_regression', 'not_comparable') as verified from q)
select k as p_partkey, status as runtime_lock_status, comparable, case when not comparable then 'not_comparable' when worse or coalesce(lock_conclusion, '') = 'candidate_regression' then 'candidate_regression'
  when better then case when verified then 'verified_improvement' else 'candidate_improvement' end else 'no_material_change' end as conclusion from v""",
)
def optimization_verdict(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    none, metric = F.array().cast("array<string>"), F.array(F.lit("time"))
    pairs = views.table(spark, sf_dir, "part").select(
        "p_partkey",
        *[(key % 13 != n).alias(name) for n, name in enumerate(_ROUND_FLAGS)],
        (size % 3 > 0).alias("lock_selected"),
        F.when(size % 4 == 0, F.lit(None)).otherwise(size % 4 > 1).cast("boolean").alias("lock_comparable"),
        F.when(key % 4 == 0, "candidate_regression").when(key % 4 == 1, "not_comparable").when(key % 4 == 2, "candidate_improvement").alias("lock_conclusion"),
        F.when(key % 6 == 0, "partial").otherwise("complete").alias("lock_baseline_quality"),
        F.when(key % 9 == 0, "partial").otherwise("complete").alias("lock_candidate_quality"),
        F.lit(True).alias("treatment_changed"),
        F.when(key % 7 == 0, "failed").otherwise("passed").alias("correctness_status"),
        F.lit("no_observed_regression").alias("resource_status"),
        F.lit("verified").alias("baseline_quality"),
        F.lit("verified").alias("candidate_quality"),
        (key % 11 > 0).alias("analyses_verified"),
        F.when(key % 3 < 2, metric).otherwise(none).alias("improved_metrics"),
        F.when(key % 5 == 0, metric).otherwise(none).alias("regressed_metrics"),
    )
    return P.optimization_verdict(pairs).select("p_partkey", "runtime_lock_status", "comparable", "conclusion")


# devices 8:d of the first snapshot (d up to k % 4) and of the last one (d from k % 3 up to k % 3 + k % 5), each with counters of its own
@query(
    "device_io",
    """with p as (select p_partkey as k, p_size as s from part),
a as (select k, sum(d * 10 + s) as r, sum(d + 1) as w from (select k, s, unnest(range(0, k % 4)) as d from p) group by k),
b as (select k, sum(d * 17 + 2 * s) as r, sum(d * 3) as w from (select k, s, unnest(range(k % 3, k % 3 + k % 5)) as d from p) group by k)
select k as capture_id, cast(coalesce(b.r, 0) - coalesce(a.r, 0) as bigint) as io_read_bytes, cast(coalesce(b.w, 0) - coalesce(a.w, 0) as bigint) as io_write_bytes,
  coalesce(b.r, 0) < coalesce(a.r, 0) as read_fell, coalesce(b.w, 0) < coalesce(a.w, 0) as write_fell,
  coalesce(b.r, 0) >= coalesce(a.r, 0) and coalesce(b.w, 0) >= coalesce(a.w, 0) as valid from p left join a using (k) left join b using (k)""",
)
def device_io(spark, sf_dir):
    """Devices that are there in one snapshot only count as 0 in the other."""
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("capture_id"), F.col("p_size").cast("long").alias("s"))
    key = F.col("capture_id")

    def devices(first, count, read, write):
        places = F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(F.array().cast("array<bigint>"))
        zero = F.lit(0).cast("long")
        return F.transform(
            places, lambda d: F.struct(F.lit(8).alias("major"), d.alias("minor"), read(d).alias("read_bytes"), write(d).alias("write_bytes"), zero.alias("read_ios"), zero.alias("write_ios"))
        )

    s = F.col("s")
    before = part.select("capture_id", F.lit(1).cast("long").alias("ts_ns"), devices(F.lit(0).cast("long"), key % 4, lambda d: d * 10 + s, lambda d: d + 1).alias("io_devices"))
    after = part.select("capture_id", F.lit(9).cast("long").alias("ts_ns"), devices(key % 3, key % 5, lambda d: d * 17 + 2 * s, lambda d: d * 3).alias("io_devices"))
    rows = V.resource_delta(before.unionByName(after))
    fell = lambda name: F.array_contains("negative_counters", name)
    return rows.select("capture_id", "io_read_bytes", "io_write_bytes", fell("io_read_bytes").alias("read_fell"), fell("io_write_bytes").alias("write_fell"), "valid")


@query(
    "stack_frames",
    f"""with {views.DUCK_RUNTIME} select capture_id, event_id, stack_id, case when stack_id is not null and stack_id <> 's3' then 'root;' || stack_id end as frames from rt""",
)
def stack_frames(spark, sf_dir):
    """Frames joined to the events; a stack that is not known and an event without one leave the event as it is."""
    events = views.runtime_lock_events(spark, sf_dir)
    stacks = events.where("stack_id <> 's3'").select("capture_id", "stack_id").distinct().withColumn("frames", F.array(F.lit("root"), F.col("stack_id")))
    return G.with_stack_frames(events.select("capture_id", "event_id", "stack_id"), stacks).withColumn("frames", F.array_join("frames", ";"))


@query(
    "diagnosis_texts",
    """with p as (select p_partkey as k, p_size as s from part), c as (select k, unnest(['b' || (s % 3), 'a', 'b' || (s % 2)]) as t from p where k % 4 > 0)
select k as capture_id, array_to_string(list_distinct_ordered, ',') as limitations, coalesce(m, '') as missing_evidence,
  case when k % 6 = 1 or len(list_distinct_ordered) > 0 or coalesce(m, '') <> '' then 'partial' else 'complete' end as status
from (select k, s, list_filter([case when s % 4 = 0 then 'x' end, case when s % 4 = 0 then 'no_call_graph' when k % 5 = 0 then 'no_call_graph' end, case when s % 7 = 0 then 'no_source_lines' end, case when k % 8 = 3 then 'unknown_event' end], lambda v: v is not null) as list_distinct_ordered,
  (select string_agg(t, ',' order by t) from (select distinct t from (select t from c where c.k = p.k union all select 'forbidden:f' where p.s % 5 = 0 union all select 'no_rule_matched' where p.k % 4 = 0))) as m from p)""",
)
def diagnosis_texts(spark, sf_dir):
    """Texts of a diagnosis: limitations in their order without repeats, missing evidence sorted without repeats."""
    key, size = F.col("p_partkey"), F.col("p_size")
    part = views.table(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    quality = part.select(
        key.alias("capture_id"), F.when(key % 6 == 1, "partial").otherwise("verified").alias("quality_status"),
        F.when(size % 4 == 0, F.array(F.lit("x"), F.lit("no_call_graph"), F.lit("x"))).otherwise(none).alias("limitations"),
        F.when(size % 5 == 0, F.array(F.lit("f"))).otherwise(none).alias("forbidden_conclusions"), (key % 5 > 0).alias("has_call_graph"),
        (size % 7).alias("source_line_frame_count"), F.when(key % 8 == 3, "unknown").otherwise("cycles").alias("event"),
    )
    number = lambda n: F.concat(F.lit("b"), (size % n).cast("string"))
    classes = part.where(key % 4 > 0).select(key.alias("capture_id"), F.explode(F.array(F.array(number(3), F.lit("a")), F.array(number(2), F.lit("a")))).alias("missing_evidence"))
    rows = C.diagnosis(quality, classes)
    return rows.select("capture_id", F.array_join("limitations", ",").alias("limitations"), F.array_join("missing_evidence", ",").alias("missing_evidence"), "status")


@query(
    "benchmark_report",
    """select p_brand || p_partkey as metric, '| `' || p_brand || p_partkey || '` | ns | ' || p_size || '/' || (p_size + 1) || ' | ' || (p_size * 0.25 + 1)::double || ' | ' || (p_size * 0.5 + 1)::double || ' | '
  || case when p_size % 3 = 0 then 'n/a%' else (p_size * 0.5)::double || '%' end || ' | ' || case p_size % 4 when 0 then 'insufficient data' when 1 then 'true' else 'false' end || ' | ' || (p_size % 2 = 0)
  || ' | `' || p_type || '` |' as line from part""",
)
def benchmark_report(spark, sf_dir):
    size = F.col("p_size")
    deltas = views.table(spark, sf_dir, "part").select(
        F.concat("p_brand", F.col("p_partkey").cast("string")).alias("metric"), F.lit("ns").alias("unit"), size.cast("string").alias("baseline_samples"), (size + 1).cast("string").alias("candidate_samples"),
        (size * 0.25 + 1).cast("double").alias("baseline_median"), (size * 0.5 + 1).cast("double").alias("candidate_median"), F.when(size % 3 > 0, (size * 0.5).cast("double")).alias("improvement_percent"),
        F.when(size % 4 > 0, size % 4 == 1).alias("statistically_significant"), (size % 2 == 0).alias("practically_significant"), F.col("p_type").alias("status"),
    )
    return sinks.benchmark_comparison_report(deltas)


@query(
    "profile_report",
    """with d as (select *, cast(row_number() over (order by greatest(abs(p_size * 0.5 - 10), abs(p_size * 0.25 - 3)) desc, p_name || p_partkey, p_brand) as int) as position from part)
select position, '| changed | `' || p_name || p_partkey || '` | `' || p_brand || '` | 10.0% | ' || (p_size * 0.5)::double || '% | ' || (p_size * 0.5 - 10)::double || ' | 3.0% | ' || (p_size * 0.25)::double || '% | '
  || (p_size * 0.25 - 3)::double || ' | ' || case when p_size % 3 = 0 then 'n/a' else cast(p_size - 5 as varchar) end || ' |' as line from d""",
)
def profile_report(spark, sf_dir):
    """Report rows of changed hotspots in the order of their change, ties by name."""
    size = F.col("p_size")
    ten, three = F.lit(10.0), F.lit(3.0)
    deltas = views.table(spark, sf_dir, "part").select(
        F.lit("changed").alias("status"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_brand").alias("dso"), ten.alias("baseline_self_percent"),
        (size * 0.5).cast("double").alias("candidate_self_percent"), (size * 0.5 - 10).cast("double").alias("self_delta_percent"), three.alias("baseline_inclusive_percent"),
        (size * 0.25).cast("double").alias("candidate_inclusive_percent"), (size * 0.25 - 3).cast("double").alias("inclusive_delta_percent"), F.when(size % 3 > 0, size - 5).alias("rank_delta"),
    )
    lines = sinks.profile_comparison_report(P.order_hotspot_deltas(deltas))
    from gristmill.operators.ordered import dense_index

    rows = dense_index(lines.withColumn("all", F.lit(0)).withColumn("down", -F.col("size")), ["all"], ["down", "symbol", "dso"], F.floor(F.col("down")), "position")
    return rows.select((F.col("position") + 1).cast("int").alias("position"), "line")
