"""Queries over comparisons, classification, quality, pages, counters and benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import bench as B
from gristmill.operators import classify as C
from gristmill.operators import compare as P
from gristmill.operators import hotspots as H
from gristmill.operators import locks as K
from gristmill.operators import pages as G
from gristmill.operators import quality as Q
from gristmill.operators import resources as V
from gristmill.operators import stat as T
from gristmill.operators.ordered import cut, cut_texts
from gristmill.plans import views
from gristmill.plans.profile_queries import (
    _DUCK_FRAMES,
    _DUCK_PATH_TEXT,
    _DUCK_PATHS,
    exported_call_paths,
    exported_hotspots,
    mixed_samples,
    path_text,
)
from gristmill.plans.registry import query
from gristmill.sources import stat as stat_source
from gristmill.sources.rules import Rule


def _sides(rows):
    return (
        rows.where("capture_id = 'baseline'").drop("capture_id"),
        rows.where("capture_id = 'candidate'").drop("capture_id"),
    )


_DUCK_DIFF = f"""{_DUCK_FRAMES},
b as (select * from exported where capture_id = 'baseline'), c as (select * from exported where capture_id = 'candidate'),
diff as (select coalesce(b.symbol, c.symbol) as symbol, coalesce(b.dso, c.dso) as dso,
  case when b.symbol is null then 'added' when c.symbol is null then 'removed' else 'changed' end as status,
  coalesce(b.self_percent, 0) as baseline_self_percent, coalesce(c.self_percent, 0) as candidate_self_percent,
  coalesce(c.self_percent, 0) - coalesce(b.self_percent, 0) as sd,
  coalesce(b.inclusive_percent, 0) as baseline_inclusive_percent, coalesce(c.inclusive_percent, 0) as candidate_inclusive_percent,
  coalesce(c.inclusive_percent, 0) - coalesce(b.inclusive_percent, 0) as id,
  b.rank as baseline_rank, c.rank as candidate_rank, b.rank - c.rank as rank_delta
  from b full outer join c on b.symbol = c.symbol and b.dso = c.dso)
"""


def _diff_sql(threshold):
    return f"""with {_DUCK_DIFF} select symbol, dso, status, baseline_self_percent, candidate_self_percent,
    round(sd, 6) as self_delta_percent, baseline_inclusive_percent, candidate_inclusive_percent,
    round(id, 6) as inclusive_delta_percent, baseline_rank, candidate_rank, rank_delta from diff
    where status <> 'changed' or greatest(abs(sd), abs(id)) >= {threshold}"""


@query("profile_diff", _diff_sql(0.05))
def profile_diff(spark, sf_dir):
    return P.profile_diff(*_sides(exported_hotspots(spark, sf_dir)), min_delta=0.05)


@query(
    "rank_delta",
    f"""with {_DUCK_DIFF} select rank_delta, count(*) as hotspots from diff where rank_delta is not null group by all""",
)
def rank_delta(spark, sf_dir):
    deltas = P.profile_diff(*_sides(exported_hotspots(spark, sf_dir)), min_delta=0.0)
    return deltas.where("rank_delta is not null").groupBy("rank_delta").agg(F.count(F.lit(1)).alias("hotspots"))


@query(
    "path_diff",
    f"""with {_DUCK_PATHS}, b as (select path, percent from exported_paths where capture_id = 'baseline'),
c as (select path, percent from exported_paths where capture_id = 'candidate'),
d as (select coalesce(b.path, c.path) as path, case when b.path is null then 'added' when c.path is null then 'removed' else 'changed' end as status,
  coalesce(b.percent, 0) as baseline_percent, coalesce(c.percent, 0) as candidate_percent,
  coalesce(c.percent, 0) - coalesce(b.percent, 0) as delta from b full outer join c on b.path = c.path)
select {_DUCK_PATH_TEXT} as frames, status, baseline_percent, candidate_percent, round(delta, 6) as delta_percent from d
where status <> 'changed' or abs(delta) >= 0.01""",
)
def path_diff(spark, sf_dir):
    deltas = P.path_diff(*_sides(exported_call_paths(spark, sf_dir)), min_delta=0.01)
    return deltas.select(
        path_text().alias("frames"), "status", "baseline_percent", "candidate_percent", "delta_percent"
    )


# the object of a leaf: its brand and one of fifty builds
_BUILDS = "select capture_id, {leaf} as symbol, leaf_dso || '#' || cast(l_suppkey % 50 as {text}) as dso"


@query(
    "dso_changes",
    f"""with {views.DUCK_SAMPLES}, o as ({_BUILDS.format(leaf="string_split(stack, ';')[-1]", text='varchar')} from samples),
s as (select symbol, array_to_string(list_sort(list(distinct dso) filter (capture_id = 'baseline')), ',') as bd,
  array_to_string(list_sort(list(distinct dso) filter (capture_id = 'candidate')), ',') as cd from o group by symbol)
select symbol, coalesce(bd, '') as baseline_dsos, coalesce(cd, '') as candidate_dsos from s where coalesce(bd, '') <> coalesce(cd, '')""",
)
def dso_changes(spark, sf_dir):
    text = _BUILDS.format(leaf="element_at(split(stack, ';'), -1)", text="string") + " from {rows}"
    rows = spark.sql(text, rows=views.stack_rows(spark, sf_dir))
    rows = P.dso_changes(*_sides(rows))
    return rows.select(
        "symbol",
        F.array_join("baseline_dsos", ",").alias("baseline_dsos"),
        F.array_join("candidate_dsos", ",").alias("candidate_dsos"),
    )


# conditions of two benchmark sides per part brand: sizes, containers and types seen
_CONDITIONS = """
select p_brand as pair_id, {side} as side, cast(min(p_size) as varchar) as f1, cast(max(p_size) as varchar) as f2,
  min(p_type) as f3, cast(count(*) as varchar) as f4 from part group by p_brand, {side}
"""


def _conditions(spark, sf_dir):
    text = _CONDITIONS.format(side="p_partkey % 2").replace("varchar", "string").replace("from part", "from {part}")
    rows = spark.sql(text, part=views.table(spark, sf_dir, "part")).select(
        "pair_id",
        "side",
        F.create_map(
            F.lit("size_min"), "f1", F.lit("size_max"), "f2", F.lit("type"), "f3", F.lit("operations"), "f4"
        ).alias("fields"),
    )
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


@query(
    "condition_diff",
    f"""with r as ({_CONDITIONS.format(side='p_partkey % 2')}), l as (select pair_id, side, unnest(['size_min', 'size_max', 'type', 'operations']) as field,
  unnest([f1, f2, f3, f4]) as value from r),
b as (select * from l where side = 0), c as (select * from l where side = 1)
select coalesce(b.pair_id, c.pair_id) as pair_id, coalesce(b.field, c.field) as field, b.value as baseline_value, c.value as candidate_value
from b full outer join c on b.pair_id = c.pair_id and b.field = c.field where b.value is distinct from c.value""",
)
def condition_diff(spark, sf_dir):
    return P.condition_diff(*_conditions(spark, sf_dir), pair=["pair_id"])


# part names and brands stand for symbols and objects
RULES = (
    Rule(id="names", category="copy", symbol_regex=(r"^part", r"COPPER$"), inclusive_percent_gte=0.02),
    Rule(id="objects", category="runtime", symbol_regex=(r".+",), dso_regex=(r"brand#1[0-9]?$",), self_percent_gte=0.05),
    Rule(id="regions", category="kernel", symbol_regex=(r"^(asia|EUROPE)$",), confidence="medium", inclusive_percent_gte=1),
)

_DUCK_CLASSIFY = f"""{_DUCK_FRAMES}, m as (
  select *, 'names' as rule_id, 0 as rule_no, 'copy' as category, 'low' as confidence from exported
    where regexp_matches(symbol, '^part|COPPER$', 'i') and inclusive_percent >= 0.02
  union all select *, 'objects', 1, 'runtime', 'low' from exported where length(symbol) > 0 and regexp_matches(dso, 'brand#1[0-9]?$', 'i')
    and self_percent >= 0.05
  union all select *, 'regions', 2, 'kernel', 'medium' from exported where regexp_matches(symbol, '^(asia|EUROPE)$', 'i') and inclusive_percent >= 1),
cl as (select *, row_number() over (partition by capture_id order by rank, rule_no) as cn from m)
"""


@query(
    "classify",
    f"""with {_DUCK_CLASSIFY} select capture_id, 'C-' || lpad(cast(cn as varchar), cast(greatest(3, length(cast(cn as varchar))) as int), '0') as classification_id,
  rule_id, hotspot_id, symbol, dso, category, confidence, 'L2' as evidence_level, self_weight = 0 as has_counter from cl""",
)
def classify(spark, sf_dir):
    rows = C.classify(exported_hotspots(spark, sf_dir), RULES)
    return rows.select(
        "capture_id",
        "classification_id",
        "rule_id",
        "hotspot_id",
        "symbol",
        "dso",
        "category",
        "confidence",
        "evidence_level",
        (F.size("counter_evidence") > 0).alias("has_counter"),
    )


@query(
    "observations",
    f"""with {_DUCK_FRAMES} select capture_id, rank, format('{{}} {{}} self={{:.3f}}% inclusive={{:.3f}}%', hotspot_id, symbol, self_percent, inclusive_percent)
  as observation from exported where rank <= 10""",
)
def observations(spark, sf_dir):
    return C.observations(exported_hotspots(spark, sf_dir))


@query(
    "diagnosis",
    f"""with {_DUCK_CLASSIFY} select capture_id, 'partial' as status, count(*) as classifications, count(distinct category) as categories from cl group by all""",
)
def diagnosis(spark, sf_dir):
    samples = views.samples(spark, sf_dir, kept=True)
    spots = cut(H.hotspots(samples))
    found = cut(C.classify(H.export_hotspots(spots, kept=True), RULES))
    status = C.diagnosis(Q.evidence_quality(samples.drop("sample_seq"), spots=spots), found).select("capture_id", "status")
    counts = (
        found.groupBy("capture_id", "category")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("capture_id")
        .agg(F.sum("n").alias("classifications"), F.count(F.lit(1)).alias("categories"))
    )
    return status.join(counts, "capture_id")


@query(
    "hotspot_page",
    f"""with {_DUCK_CLASSIFY}, k as (select * from exported e where exists (select 1 from cl where cl.capture_id = e.capture_id
    and cl.hotspot_id = e.hotspot_id and category = 'runtime')),
p as (select *, row_number() over (partition by capture_id order by inclusive_percent desc, symbol, dso) - 1 as position,
  count(*) over (partition by capture_id) as total_items from k)
select capture_id, hotspot_id, symbol, dso, inclusive_percent, cast(position as int) as position, total_items,
  case when 45 < total_items then 45 end as next_cursor from p where position >= 5 and position < 45""",
)
def hotspot_page(spark, sf_dir):
    spots = exported_hotspots(spark, sf_dir)
    rows = G.hotspot_page(spots, "inclusive_percent", 5, 40, C.classify(spots, RULES), "runtime")
    return rows.select(
        "capture_id", "hotspot_id", "symbol", "dso", "inclusive_percent", "position", "total_items", "next_cursor"
    )


@query(
    "call_path_page",
    f"""with {_DUCK_PATHS}, k as (select * from exported_paths where len(list_filter(path, lambda f: f.symbol = 'ASIA')) > 0),
p as (select *, row_number() over (partition by capture_id order by rank) - 1 as position, count(*) over (partition by capture_id) as total_items from k)
select capture_id, path_id, weight, cast(position as int) as position, total_items, case when 100 < total_items then 100 end as next_cursor
from p where position < 100""",
)
def call_path_page(spark, sf_dir):
    rows = G.call_path_page(exported_call_paths(spark, sf_dir), "ASIA", 0, 100)
    return rows.select("capture_id", "path_id", "weight", "position", "total_items", "next_cursor")


@query(
    "hotspot_paths",
    f"""with {_DUCK_FRAMES}, {_DUCK_PATHS.replace(views.DUCK_SAMPLES + ',', '')},
m as (select distinct p.capture_id, p.path_id, p.rank as path_rank, p.weight as path_weight, u.f.symbol as symbol, u.f.dso as dso
  from exported_paths p, lateral (select unnest(p.path) as f) u),
r as (select *, cast(row_number() over (partition by capture_id, symbol, dso order by path_rank) as int) as position from m)
select e.capture_id, e.hotspot_id, e.symbol, e.dso, r.path_id, r.path_rank, r.path_weight, r.position from exported e
join r on e.capture_id = r.capture_id and e.symbol = r.symbol and e.dso = r.dso where position <= 10""",
)
def hotspot_paths(spark, sf_dir):
    samples = views.samples(spark, sf_dir, kept=True)
    return G.hotspot_paths(
        H.export_hotspots(H.hotspots(samples)), H.export_call_paths(H.call_paths(samples))
    )


@query(
    "hotspots_from_paths",
    f"""with {_DUCK_FRAMES} select capture_id, symbol, dso, self_weight, inclusive_weight from spots""",
)
def hotspots_from_paths(spark, sf_dir):
    return H.hotspots_from_paths(H.call_paths(views.samples(spark, sf_dir)))


_CHECKS = (
    "self_weight", "call_path_weight", "unknown_within_total", "call_graph_within_total",
    "source_line_within_total", "context_sum", "unresolved_sum", "one_scope",
)


@query(
    "aggregation_invariants",
    f"""with {views.DUCK_SAMPLES} select capture_id, "check", not ("check" = 'one_scope' and second) as passed
  from (select capture_id, bool_or(capture_id = 'candidate' and l_linenumber = 7) as second, unnest({list(_CHECKS)}) as "check" from samples group by capture_id)""",
)
def aggregation_invariants(spark, sf_dir):
    return Q.aggregation_invariants(mixed_samples(spark, sf_dir, kept=True))


@query(
    "evidence_quality",
    f"""with {_DUCK_FRAMES}, {_DUCK_PATHS.replace(views.DUCK_SAMPLES + ',', '')},
t as (select capture_id, cast(sum(weight) as bigint) as total_weight, count(*) as record_count,
    cast(sum(weight) filter (sample_context = 'kernel') as bigint) as kw from samples group by all),
s as (select capture_id, count(*) as total_hotspot_count, least(count(*), 40) as exported_hotspot_count,
    cast(sum(self_weight) filter (rank <= 40) as bigint) as sw from ranked group by all),
p as (select capture_id, count(*) as total_call_path_count, count(*) as exported_call_path_count,
    cast(sum(weight) as bigint) as pw from path_rank group by all)
select t.capture_id, total_weight, record_count, round(kw * 100.0::double / total_weight, 6) as kernel_context_self_percent,
  total_hotspot_count, exported_hotspot_count, total_weight - sw as omitted_hotspot_self_weight, total_call_path_count,
  exported_call_path_count, total_weight - pw as omitted_call_path_weight,
  case when total_weight > sw or total_weight > pw then 'partial' else 'verified' end as quality_status,
  'sampled_event_hotspot_distribution,call_path_distribution,sample_privilege_distribution' as allowed,
  'performance_root_cause,verified_improvement,instructions_per_cycle,hardware_cache_miss_rate,hardware_branch_miss_rate,microarchitectural_bottleneck,exact_source_line_attribution'
    || case when total_weight > sw or total_weight > pw then ',complete_profile_distribution,unqualified_profile_conclusion' else '' end as forbidden
from t join s on t.capture_id = s.capture_id join p on t.capture_id = p.capture_id""",
)
def evidence_quality(spark, sf_dir):
    # a report of the first 40 hotspots and of all paths: what it leaves out is counted
    rows = Q.evidence_quality(views.samples(spark, sf_dir, kept=True), hotspot_limit=40)
    return rows.select(
        "capture_id",
        "total_weight",
        "record_count",
        "kernel_context_self_percent",
        "total_hotspot_count",
        "exported_hotspot_count",
        "omitted_hotspot_self_weight",
        "total_call_path_count",
        "exported_call_path_count",
        "omitted_call_path_weight",
        "quality_status",
        F.array_join("allowed_conclusions", ",").alias("allowed"),
        F.array_join("forbidden_conclusions", ",").alias("forbidden"),
    )


@query(
    "verify_exports",
    f"""with {views.DUCK_SAMPLES} select capture_id, count(*) as checks, true as passed from (select distinct capture_id from samples),
  (select unnest(range(22))) group by capture_id""",
)
def verify_exports(spark, sf_dir):
    samples = views.samples(spark, sf_dir, kept=True)
    spots, paths = cut(H.hotspots(samples)), cut_texts(H.call_paths(samples))
    checks = Q.verify_exports(
        H.export_hotspots(spots, kept=True),
        H.export_call_paths(paths, kept=True),
        Q.evidence_quality(samples.drop("sample_seq"), spots=spots, paths=paths),
    )
    return checks.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("checks"), F.bool_and("passed").alias("passed")
    )


# counter text: one capture per supplier, cycles and instructions from its line items
_STAT_TEXT = """
select l_suppkey as capture_id, l_orderkey * 8 + l_linenumber as line_no,
  case when l_orderkey % 41 = 0 then '# comment' when l_orderkey % 43 = 0 then '<not supported>;;branch-misses;0;0.00'
    when l_orderkey % 47 = 0 then 'damaged-row' when l_orderkey % 53 = 0 then 'abc;;cycles;1;2'
    else concat_ws(';', cast(cast(l_quantity as bigint) * 1000 as varchar), '',
      case l_linenumber % 3 when 0 then 'cycles' when 1 then 'instructions' else 'cache-misses' end,
      cast(l_partkey as varchar), '99.50') end as line
from lineitem
"""


def _stat_rows(spark, sf_dir):
    text = _STAT_TEXT.replace("varchar", "string").replace("from lineitem", "from {lineitem}")
    return stat_source.parse_stat(spark.sql(text, lineitem=views.table(spark, sf_dir, "lineitem")))


_DUCK_STAT = f"""lines as ({_STAT_TEXT}),
f as (select *, string_split(line, ';') as p from lines),
r as (select *, case when line like '#%' then 'SKIP' when len(p) < 3 then 'TOO_FEW_FIELDS' when p[3] = '' then 'NO_EVENT'
  when p[1] not like '%not supported%' and try_cast(p[1] as double) is null then 'INVALID_VALUE' end as reject from f),
m as (select capture_id, line_no, p[3] as event, case when p[1] like '%not supported%' then null else try_cast(p[1] as double) end as value,
  try_cast(p[4] as bigint) as run_time_ns, try_cast(p[5] as double) as running_percent,
  case when p[1] like '%not supported%' then 'not_supported' else 'measured' end as status from r where reject is null)
"""


@query(
    "stat_rows",
    f"""with {_DUCK_STAT} select coalesce(reject, 'OK') as outcome, event, r.status, count(*) as rows, sum(value) as value_sum,
    cast(sum(run_time_ns) as bigint) as run_time_ns from (select reject, case when reject is null then p[3] end as event,
    case when reject is null then case when p[1] like '%not supported%' then 'not_supported' else 'measured' end end as status,
    case when reject is null and p[1] not like '%not supported%' then try_cast(p[1] as double) end as value,
    case when reject is null then try_cast(p[4] as bigint) end as run_time_ns from r) r group by all""",
)
def stat_rows(spark, sf_dir):
    good = F.col("reject").isNull()
    return (
        _stat_rows(spark, sf_dir)
        .groupBy(
            F.coalesce("reject", F.lit("OK")).alias("outcome"),
            F.when(good, F.col("event")).alias("event"),
            F.when(good, F.col("status")).alias("status"),
        )
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.when(good, F.col("value"))).alias("value_sum"),
            F.sum(F.when(good, F.col("run_time_ns"))).alias("run_time_ns"),
        )
    )


@query(
    "stat_ipc",
    f"""with {_DUCK_STAT}, v as (select capture_id, max_by(value, line_no) filter (event = 'cycles') as c,
  max_by(value, line_no) filter (event = 'instructions') as i from m where status = 'measured' group by capture_id)
select capture_id, 'instructions-per-cycle' as event, i / c as value from v where i is not null and c > 0""",
)
def stat_ipc(spark, sf_dir):
    return T.ipc(stat_source.stat_metrics(_stat_rows(spark, sf_dir))).select("capture_id", "event", "value")


@query(
    "stat_event_sets",
    f"""with {_DUCK_STAT}, d as (select capture_id, count(*) - count(distinct event) as duplicate_events,
  bool_and(event in ('cycles', 'instructions')) and count(distinct event) = 2 as event_set_matches,
  true as has_hardware_event, coalesce(bool_or(event in ('cycles', 'instructions') and status = 'measured' and value > 0), false) as has_usable_hardware_metric
  from m group by capture_id) select * from d""",
)
def stat_event_sets(spark, sf_dir):
    metrics = stat_source.stat_metrics(_stat_rows(spark, sf_dir))
    requested = metrics.select("capture_id").distinct().select(
        "capture_id", F.explode(F.array(F.lit("cycles:u"), F.lit("cpu_core/instructions/"))).alias("event")
    )
    return T.event_set_checks(metrics, requested).drop("only_software_events")


_BENCH = """
select case when l_shipdate < TIMESTAMP '2000-01-01 00:00:00' then 'baseline' else 'candidate' end as side,
  l_returnflag || '_' || l_linestatus as metric, l_extendedprice as value from lineitem
"""


def bench_stats_rows(spark, sf_dir):
    rows = spark.sql(_BENCH.replace("from lineitem", "from {lineitem}"), lineitem=views.table(spark, sf_dir, "lineitem"))
    return B.metric_stats(rows, ["side", "metric"]).select(
        "*", F.lit("seconds").alias("unit"), (F.col("metric") < "B").alias("higher_is_better")
    )


_DUCK_BENCH = f"""v as ({_BENCH}), st as (select side, metric, count(*) as samples, median(value) as median, avg(value) as mean,
  coalesce(stddev_samp(value), 0) as sd, metric < 'B' as hib from v group by all)"""


@query(
    "bench_stats",
    f"with {_DUCK_BENCH} select side, metric, samples, round(median, 4) as median, round(mean, 4) as mean, round(sd, 4) as standard_deviation from st",
)
def bench_stats(spark, sf_dir):
    return bench_stats_rows(spark, sf_dir).select(
        "side",
        "metric",
        "samples",
        F.round("median", 4).alias("median"),
        F.round("mean", 4).alias("mean"),
        F.round("standard_deviation", 4).alias("standard_deviation"),
    )


def bench_deltas(spark, sf_dir):
    rows = bench_stats_rows(spark, sf_dir)
    return P.benchmark_diff(
        rows.where("side = 'baseline'").drop("side"), rows.where("side = 'candidate'").drop("side"), min_practical=0.1
    )


_DUCK_BENCH_DIFF = f"""{_DUCK_BENCH}, j as (select b.metric, b.samples as bs, c.samples as cs, b.median as bm, c.median as cm, b.hib,
  case when b.median <> 0 then (c.median - b.median) * 100 / abs(b.median) end as raw, c.mean - b.mean as diff,
  sqrt(b.sd * b.sd / b.samples + c.sd * c.sd / c.samples) as se from st b join st c on b.metric = c.metric and b.side = 'baseline' and c.side = 'candidate'),
k as (select *, case when hib then raw else -raw end as imp, diff - 1.96 * se as lo, diff + 1.96 * se as hi, bs >= 3 and cs >= 3 as enough from j),
bd as (select metric, bs as baseline_samples, cs as candidate_samples, round(bm, 4) as baseline_median, round(cm, 4) as candidate_median,
  round(raw, 4) as raw_delta_percent, round(imp, 4) as improvement_percent, round(lo, 3) as interval_low, round(hi, 3) as interval_high,
  lo > 0 or hi < 0 as statistically_significant, coalesce(abs(imp) >= 0.1, false) as practically_significant,
  case when not enough then 'insufficient_data' when not (coalesce(abs(imp) >= 0.1, false)) or not (lo > 0 or hi < 0) then 'no_material_change'
    when imp > 0 then 'candidate_improvement' else 'candidate_regression' end as status from k)"""


@query("bench_compare", f"with {_DUCK_BENCH_DIFF} select * from bd")
def bench_compare(spark, sf_dir):
    return bench_deltas(spark, sf_dir).select(
        "metric",
        "baseline_samples",
        "candidate_samples",
        F.round("baseline_median", 4).alias("baseline_median"),
        F.round("candidate_median", 4).alias("candidate_median"),
        F.round("raw_delta_percent", 4).alias("raw_delta_percent"),
        F.round("improvement_percent", 4).alias("improvement_percent"),
        F.round("interval_low", 3).alias("interval_low"),
        F.round("interval_high", 3).alias("interval_high"),
        "statistically_significant",
        "practically_significant",
        "status",
    )


@query(
    "bench_unmatched",
    """with v as (select l_linenumber % 2 as side, p_brand || case when l_quantity > 49 then p_type else '' end as metric
  from lineitem join part on l_partkey = p_partkey), b as (select distinct metric from v where side = 0), c as (select distinct metric from v where side = 1)
select metric, 'baseline' as only_in from b where metric not in (select metric from c) union all
select metric, 'candidate' from c where metric not in (select metric from b)""",
)
def bench_unmatched(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    rows = views.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_linenumber") % 2).alias("side"),
        F.concat("p_brand", F.when(F.col("l_quantity") > 49, F.col("p_type")).otherwise("")).alias("metric"),
    )
    return P.unmatched_metrics(
        rows.where("side = 0").select("metric").distinct(), rows.where("side = 1").select("metric").distinct()
    )


_SNAPSHOTS = """
select user_id as capture_id, event_id, {EPOCH_US} * 1000 as ts_ns,
  sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id) as cpu_usage_usec,
  sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) as cpu_nr_throttled,
  case when event_id % 3 = 0 then 100000 end as cpu_quota_usec from events
"""


def _snapshots(spark, sf_dir):
    """Cumulative counters per user; the running sum is the given input, so it is built in spans."""
    from gristmill.operators.ordered import running, running_sum

    rows = views.event_rows(spark, sf_dir).select(
        F.col("user_id").alias("capture_id"),
        "event_id",
        "event_index",
        "ts_ns",
        F.round(F.col("value") * 100).cast("bigint").alias("usage"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("throttled"),
        F.when(F.col("event_id") % 3 == 0, 100000).alias("cpu_quota_usec"),
    )
    return running(
        rows,
        ["capture_id"],
        "event_index",
        {"cpu_usage_usec": running_sum(F.col("usage")), "cpu_nr_throttled": running_sum(F.col("throttled"))},
    ).drop("usage", "throttled", "event_index")


_DUCK_DELTA = f"""s as ({_SNAPSHOTS.replace('{EPOCH_US}', views.DUCK_EPOCH)}),
o as (select *, row_number() over (partition by capture_id order by ts_ns, event_id) as rn,
  count(*) over (partition by capture_id) as snapshots from s),
dl as (select b.capture_id, b.snapshots, c.ts_ns - b.ts_ns as window_ns,
  cast(c.cpu_usage_usec - b.cpu_usage_usec as bigint) as cpu_usage_usec, cast(c.cpu_nr_throttled - b.cpu_nr_throttled as bigint) as cpu_nr_throttled,
  case when c.cpu_usage_usec < b.cpu_usage_usec then 'cpu_usage_usec' else '' end as negative_counters,
  case when b.cpu_quota_usec is distinct from c.cpu_quota_usec then 'cpu_quota' else '' end as changed_limits
  from o b join o c on b.capture_id = c.capture_id and b.rn = 1 and c.rn = c.snapshots)"""


@query(
    "resource_delta",
    f"with {_DUCK_DELTA} select *, negative_counters = '' and window_ns > 0 as valid from dl",
)
def resource_delta(spark, sf_dir):
    rows = V.resource_delta(_snapshots(spark, sf_dir))
    return rows.withColumn("negative_counters", F.array_join("negative_counters", ",")).withColumn(
        "changed_limits", F.array_join("changed_limits", ",")
    )


@query(
    "resource_status",
    f"""with {_DUCK_DELTA}, p as (select b.capture_id // 2 as pair_id, b.cpu_usage_usec as bu, c.cpu_usage_usec as cu,
  b.cpu_nr_throttled as bt, c.cpu_nr_throttled as ct from dl b join dl c on c.capture_id = b.capture_id + 1 and b.capture_id % 2 = 0)
select pair_id, case when cu > bu then 'regression' when ct > bt then 'regression' else 'incomplete' end as resource_status from p""",
)
def resource_status(spark, sf_dir):
    rows = V.resource_delta(_snapshots(spark, sf_dir)).withColumn("pair_id", F.floor(F.col("capture_id") / 2))
    return V.transfer_status(
        rows.where("capture_id % 2 = 0"), rows.where("capture_id % 2 = 1"), ["pair_id"]
    )


# matched pairs: one per part brand; metric = mean price per container, throttling from quantities
_AB = """
select p_brand as pair_id, p_partkey % 2 as side, p_type as metric, l_extendedprice as value, l_quantity as quantity
from lineitem join part on l_partkey = p_partkey
"""


@query(
    "ab_verdict",
    f"""with v as ({_AB}), s as (select pair_id, side, metric, count(*) as n, median(value) as med, avg(value) as mean,
  coalesce(stddev_samp(value), 0) as sd from v group by all),
m as (select b.pair_id, b.metric, b.n as bn, c.n as cn, case when b.med <> 0 then -(c.med - b.med) * 100 / abs(b.med) end as imp,
  c.mean - b.mean as d, sqrt(b.sd * b.sd / b.n + c.sd * c.sd / c.n) as se
  from s b join s c on b.pair_id = c.pair_id and b.metric = c.metric and b.side = 0 and c.side = 1),
t as (select *, case when bn < 3 or cn < 3 then 'insufficient_data' when coalesce(abs(imp) >= 1, false) and (d - 1.96 * se > 0 or d + 1.96 * se < 0)
  then case when imp > 0 then 'candidate_improvement' else 'candidate_regression' end else 'no_material_change' end as status from m),
l as (select pair_id, count(*) filter (status = 'candidate_improvement') as improved, count(*) filter (status = 'candidate_regression') as regressed
  from t group by all),
r as (select pair_id, sum(quantity) filter (side = 0) as bq, sum(quantity) filter (side = 1) as cq from v group by all)
select l.pair_id, case when cq > bq then 'regression' else 'no_observed_regression' end as resource_status, improved, regressed,
  case when l.pair_id like '%5' then 'not_comparable' when regressed > 0 then 'candidate_regression'
    when improved > 0 and not cq > bq then 'verified_improvement' when improved > 0 then 'candidate_improvement' else 'no_material_change' end as conclusion
from l join r on l.pair_id = r.pair_id""",
)
def ab_verdict(spark, sf_dir):
    rows = spark.sql(
        _AB.replace("from lineitem join part", "from {lineitem} join {part}"),
        lineitem=views.table(spark, sf_dir, "lineitem"),
        part=views.table(spark, sf_dir, "part"),
    )
    stats = B.metric_stats(rows, ["pair_id", "side", "metric"]).select(
        "*", F.lit("seconds").alias("unit"), F.lit(False).alias("higher_is_better")
    )
    deltas = P.benchmark_diff(
        stats.where("side = 0").drop("side"), stats.where("side = 1").drop("side"), ["pair_id"]
    )
    used = rows.groupBy("pair_id", "side").agg(F.sum("quantity").cast("bigint").alias("used"))
    used = used.select("pair_id", "side", *[F.col("used").alias(f) for f in V.TRANSFER_FIELDS])
    status = V.transfer_status(used.where("side = 0"), used.where("side = 1"), ["pair_id"])
    pairs = P.metric_lists(deltas, ["pair_id"]).join(status, "pair_id")
    yes = F.lit(True)
    verdict = P.ab_verdict(
        pairs.select(
            "*",
            (~F.col("pair_id").endswith("5")).alias("environment_match"),
            yes.alias("profiles_comparable"),
            yes.alias("benchmarks_comparable"),
            yes.alias("containerized"),
            yes.alias("treatment_changed"),
            P.correctness_status(F.lit(0), F.lit(0)).alias("correctness_status"),
            F.lit("verified").alias("baseline_quality"),
            F.lit("verified").alias("candidate_quality"),
        )
    )
    return verdict.select(
        "pair_id",
        "resource_status",
        F.size("improved_metrics").cast("bigint").alias("improved"),
        F.size("regressed_metrics").cast("bigint").alias("regressed"),
        "conclusion",
    )


# conclusion sets of two sides per customer segment and nation
_GATES = """
select c_nationkey as pair_id, list_sort(list(distinct c_mktsegment) filter (c_custkey % 2 = 0)) as ba,
  list_sort(list(distinct c_mktsegment) filter (c_custkey % 2 = 1)) as ca,
  list_sort(list(distinct c_mktsegment) filter (c_acctbal < -800 and c_custkey % 2 = 0)) as bf,
  list_sort(list(distinct c_mktsegment) filter (c_acctbal < -800 and c_custkey % 2 = 1)) as cf from customer group by all
"""


@query(
    "gate_sets",
    f"""with g as ({_GATES}), h as (select pair_id, coalesce(ba, []) as ba, coalesce(ca, []) as ca, list_distinct(list_concat(coalesce(bf, []), coalesce(cf, []))) as f from g)
select pair_id, array_to_string(list_sort(list_filter(ba, lambda x: list_contains(ca, x) and not list_contains(f, x))), ',') as allowed,
  array_to_string(list_sort(f), ',') as forbidden from h""",
)
def gate_sets(spark, sf_dir):
    seg, odd, poor = F.col("c_mktsegment"), F.col("c_custkey") % 2 == 1, F.col("c_acctbal") < -800
    pairs = views.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("pair_id")).agg(
        F.collect_set(F.when(~odd, seg)).alias("baseline_allowed"),
        F.collect_set(F.when(odd, seg)).alias("candidate_allowed"),
        F.collect_set(F.when(poor & ~odd, seg)).alias("baseline_forbidden"),
        F.collect_set(F.when(poor & odd, seg)).alias("candidate_forbidden"),
    )
    return Q.gate_sets(pairs).select(
        "pair_id",
        F.array_join("allowed_conclusions", ",").alias("allowed"),
        F.array_join("forbidden_conclusions", ",").alias("forbidden"),
    )


@query(
    "lock_single_kind",
    """select p_brand as lock_id, cast(p_size % 2 as int) as capture_id, case when count(distinct kind) = 1 then min(kind) else 'unknown' end as lock_kind
from (select p_brand, p_size, case when p_brand like '%3' or (p_size % 2 = 0 and p_size > 40 and p_brand like '%2') then 'rwlock' else 'mutex' end as kind from part) group by all""",
)
def lock_single_kind(spark, sf_dir):
    """Locks of brands that end in 3 have one kind, those that end in 2 change it in one of two captures."""
    rows = views.table(spark, sf_dir, "part")
    brand, size = F.col("p_brand"), F.col("p_size")
    kind = F.when(brand.endswith("3") | ((size % 2 == 0) & (size > 40) & brand.endswith("2")), "rwlock").otherwise("mutex")
    events = rows.select((size % 2).cast("int").alias("capture_id"), brand.alias("lock_id"), kind.alias("lock_kind"))
    return K.single_kind(events)


# a hotspot and a rule for every part: symbols are its name, number and type; a rule's patterns depend on its size
_RULE_PARTS = """select p_partkey, p_size, lower(p_name) as name, p_type, p_brand, concat(p_name, '_', cast(p_partkey as varchar), '_', p_type) as symbol from {part}"""


@query(
    "classify_by_table",
    f"""with r as ({_RULE_PARTS.format(part='part')}), s as (select p_partkey as rank, symbol, lower(symbol) as low, name, p_type, p_brand as dso, p_size, p_size + 20 as inclusive from r),
m as (select s.*, r.p_partkey as rule_no from r join s on s.name = r.name and starts_with(s.low, r.name || '_' || r.p_partkey // 10) where r.p_size % 4 = 0
  union all select s.*, r.p_partkey from r join s on s.rank = r.p_partkey and s.low like '% widget_%' where r.p_size % 4 = 1 and (s.name like 'red %' or s.name like 'blue %')
  union all select s.*, r.p_partkey from r join s on s.name = r.name and s.p_type = r.p_type where r.p_size % 4 = 2
  union all select s.*, r.p_partkey from r join s on s.dso = r.p_brand where r.p_size % 4 = 3 and r.p_partkey % 50 <> 3
  union all select s.*, r.p_partkey from r join s on length(s.symbol) = 20 where r.p_size % 4 = 3 and r.p_partkey % 50 = 3)
select rank, rule_no, 'rule ' || rule_no as rule_id, 'see ' || symbol as observation,
  row_number() over (order by rank, rule_no) as number from m where p_size >= rule_no % 30 and inclusive >= 25""",
)
def classify_by_table(spark, sf_dir):
    rows = spark.sql(_RULE_PARTS.replace("varchar", "string"), part=views.table(spark, sf_dir, "part"))
    key, kind = F.col("p_partkey"), F.col("p_size") % 4
    digits = key.cast("string")
    free = (kind == 3) & (key % 50 == 3)
    patterns = (
        F.when(kind == 0, F.array(F.concat(F.lit("^"), "name", F.lit("_"), F.expr("p_partkey div 10").cast("string"))))
        .when(kind == 1, F.array(F.concat(F.lit("no such symbol "), digits, F.lit("$")), F.concat(F.lit("^(RED|blue) (widget)_"), digits, F.lit("_"))))
        .when(kind == 2, F.array(F.concat(F.lit("^x?"), "name", F.lit("_[0-9]+_"), F.lower("p_type"), F.lit("$"))))
        .when(free, F.array(F.lit("^.{20}$")))
        .otherwise(F.array(F.lit(".+")))
    )
    none = F.array().cast("array<string>")
    rules = rows.select(
        key.alias("rule_no"), F.concat(F.lit("rule "), digits).alias("rule_id"), F.lit(1).alias("rule_version"), F.lit("generic").alias("scope"),
        F.lit("c").alias("category"), F.lit("low").alias("confidence"), F.lit("see {symbol}").alias("observation"),
        *[none.alias(t) for t in ("limitations", "missing_evidence", "next_steps", "forbidden_conclusions")], patterns.alias("symbol_regex"),
        F.when((kind == 3) & ~free, F.array(F.concat(F.lit("^"), F.upper("p_brand"), F.lit("$")))).otherwise(none).alias("dso_regex"),
        (key % 30).cast("double").alias("self_percent_gte"), F.lit(25.0).alias("inclusive_percent_gte"),
    )
    spots = rows.select(
        F.lit(1).alias("capture_id"), digits.alias("hotspot_id"), key.alias("rank"), "symbol", F.col("p_brand").alias("dso"), F.lit(0).alias("self_weight"),
        F.col("p_size").cast("double").alias("self_percent"), (F.col("p_size") + 20).cast("double").alias("inclusive_percent"),
    )
    found = C.classify_by_table(spots, rules)
    return found.select(
        "rank", F.regexp_extract("rule_id", "[0-9]+", 0).cast("long").alias("rule_no"), "rule_id", "observation",
        F.substring("classification_id", 3, 20).cast("long").alias("number"),
    )


def _profiles(spark, sf_dir, side):
    """One profile per part: two metadata fields, a status and a sample count; sides differ by rule."""
    shift = 0 if side == "baseline" else 1
    return views.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.create_map(
            F.lit("kernel"), F.when(F.col("p_partkey") % 5 == 0, f"k{shift}").otherwise("k"),
            F.lit("period"), F.when(F.col("p_partkey") % 7 == 0, F.lit(None) if shift else F.lit("p")).otherwise("p"),
        ).alias("fields"),
        F.when(F.col("p_partkey") % 3 == shift, "partial").otherwise("verified").alias("quality_status"),
        (F.col("p_size") * 4 + shift).cast("long").alias("sample_count"),
    )


@query(
    "profile_comparability",
    """with p as (select p_partkey, p_size, list_concat(list_concat(case when p_partkey % 5 = 0 then ['kernel'] else [] end, case when p_partkey % 7 = 0 then ['period'] else [] end),
  case p_partkey % 3 when 0 then ['baseline_quality_status'] when 1 then ['candidate_quality_status'] else [] end) as d from part)
select p_partkey, array_to_string(d, ',') as differences, len(d) = 0 as comparable, p_size * 4 < 100 as few_samples from p""",
)
def profile_comparability(spark, sf_dir):
    rows = P.profile_comparability(_profiles(spark, sf_dir, "baseline"), _profiles(spark, sf_dir, "candidate"), ["p_partkey"])
    return rows.withColumn("differences", F.array_join("differences", ","))


@query(
    "trace_quality",
    """select event_type, user_id, count(*) filter (event_id % 40 = 0) as lost, count(*) filter (event_id % 50 = 1) as malformed,
  case when count(*) filter (event_id % 40 = 0 or event_id % 50 = 1) > 0 then 'partial' else 'complete' end as quality_status from events group by all""",
)
def trace_quality(spark, sf_dir):
    counters = views.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(
        F.count_if(F.col("event_id") % 40 == 0).alias("lost"), F.count_if(F.col("event_id") % 50 == 1).alias("malformed")
    )
    return Q.trace_quality(counters)


# a runtime-lock comparison per part: one of six demands fails for every seventh part each
_DEMANDS = ("adapter_match", "semantics_match", "threshold_or_sampling_match", "workload_match", "resource_environment_match", "replay_passed")


@query(
    "lock_verdicts",
    """with p as (select p_partkey, p_partkey % 11 >= 6 and p_size % 10 <> 9 as comparable, p_size % 4 = 0 as worse, p_size % 4 = 1 or p_size % 4 = 2 as better from part),
v as (select *, worse or p_partkey % 2 = 0 as regressed from p)
select p_partkey, comparable, comparable and regressed as has_regression, comparable and better as has_improvement,
  comparable and regressed and p_partkey % 2 = 0 as resource_counted,
  'distribution,runtime_lock_comparison' as allowed, 'performance_root_cause,rate,verified_improvement,waits' as forbidden from v""",
)
def lock_verdicts(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    none = F.array().cast("array<string>")
    metric = F.array(F.lit("total_exact_wait_ns"))
    pairs = views.table(spark, sf_dir, "part").select(
        "p_partkey",
        *[(key % 11 != n).alias(name) for n, name in enumerate(_DEMANDS)],
        F.when(size % 10 == 9, "failed").otherwise("passed").alias("correctness_status"),
        F.lit(None).cast("boolean").alias("treatment_changed"),
        F.when(key % 2 == 0, "regression").otherwise("no_regression").alias("resource_status"),
        F.when((size % 4).isin(1, 2), metric).otherwise(none).alias("improved_metrics"),
        F.when(size % 4 == 0, metric).otherwise(none).alias("regressed_metrics"),
        F.array(F.lit("rate"), F.lit("distribution")).alias("baseline_allowed"),
        F.array(F.lit("distribution"), F.lit("rate"), F.lit("only_here")).alias("candidate_allowed"),
        F.array(F.lit("waits")).alias("baseline_forbidden"),
        F.array(F.lit("rate")).alias("candidate_forbidden"),
    )
    rows = P.runtime_lock_verdict(pairs)
    return rows.select(
        "p_partkey",
        "comparable",
        (F.size("regressed_metrics") > 0).alias("has_regression"),
        (F.size("improved_metrics") > 0).alias("has_improvement"),
        F.array_contains("regressed_metrics", "resource_transfer").alias("resource_counted"),
        F.array_join("allowed_conclusions", ",").alias("allowed"),
        F.array_join("forbidden_conclusions", ",").alias("forbidden"),
    )
