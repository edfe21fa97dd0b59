"""Queries over stack samples: parsing, hotspots, call paths, totals, invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import symbols as S
from gristmill.operators import hotspots as H
from gristmill.plans import views
from gristmill.plans.registry import query
from gristmill.sources import folded

# text of folded records: every 50th row carries a bad weight, every 70th an empty frame,
# every 90th no weight at all
_FOLDED_TEXT = """
select capture_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when (l_orderkey * 7 + l_linenumber) % 90 = 0 then replace(stack, ' ', '_')
       when (l_orderkey * 7 + l_linenumber) % 70 = 0 then stack || ';; ' || cast(weight as varchar)
       when (l_orderkey * 7 + l_linenumber) % 50 = 0 then stack || ' x' || cast(weight as varchar)
       else stack || ' ' || cast(weight as varchar) end as line
"""


def _folded_lines(spark, sf_dir):
    text = _FOLDED_TEXT.replace("varchar", "string")
    return spark.sql(text + " from {rows}", rows=views.stack_rows(spark, sf_dir))


_DUCK_FOLDED = f"""with {views.DUCK_SAMPLES}, lines as ({_FOLDED_TEXT} from samples),
parts as (select *, regexp_extract(line, '^(.*\\S)\\s+(\\S+)$', 1) as stack,
  regexp_extract(line, '^(.*\\S)\\s+(\\S+)$', 2) as weight_text from lines),
parsed as (select *, case when regexp_full_match(weight_text, '[+-]?[0-9]+') then try_cast(weight_text as bigint) end as weight,
  list_transform(string_split(stack, ';'), lambda s: trim(s)) as syms from parts),
judged as (select *, case when trim(line) = '' then 'BLANK' when weight_text = '' then 'MISSING_WEIGHT'
  when weight is null or weight <= 0 then 'INVALID_WEIGHT' when list_contains(syms, '') then 'EMPTY_FRAME' end as reject from parsed)
"""


@query(
    "folded_parse",
    _DUCK_FOLDED
    + """select capture_id, array_to_string(syms, ';') as stack, cast(len(syms) as int) as depth,
    cast(sum(weight) as bigint) as weight, count(*) as records from judged where reject is null
    group by all""",
)
def folded_parse(spark, sf_dir):
    good = folded.parse_folded(_folded_lines(spark, sf_dir)).where("reject is null")
    return good.groupBy(
        "capture_id", F.concat_ws(";", "symbols").alias("stack"), F.size("symbols").alias("depth")
    ).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("records"))


@query(
    "folded_rejects",
    _DUCK_FOLDED
    + """select capture_id, coalesce(reject, 'OK') as code, count(*) as records from judged group by all""",
)
def folded_rejects(spark, sf_dir):
    parsed = folded.parse_folded(_folded_lines(spark, sf_dir))
    return parsed.groupBy("capture_id", F.coalesce("reject", F.lit("OK")).alias("code")).agg(
        F.count(F.lit(1)).alias("records")
    )


# raw spellings of a part name: offset, clone mark, compiler suffixes, cold mark, Rust hash
_RAW_SYMBOLS = """
select p_partkey, case p_partkey % 6
  when 0 then p_name || '+0x' || cast(p_partkey as varchar)
  when 1 then p_name || '.isra.' || cast(p_size as varchar) || '.cold'
  when 2 then p_name || '.constprop.' || cast(p_size as varchar) || ' [clone]'
  when 3 then p_name || '.part.' || cast(p_size as varchar) || '.cold+0xff'
  when 4 then p_name || '::h0123456789abcdef'
  else '  ' || p_name || ' ' end as raw_symbol
"""


@query(
    "symbol_normalize",
    f"""with raw as ({_RAW_SYMBOLS} from part)
select p_partkey, raw_symbol, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  trim(raw_symbol), '\\+0x[0-9a-fA-F]+$', ''), ' \\[clone\\]$', ''), '\\.(?:isra|constprop|part)\\.\\d+$', ''),
  '\\.cold$', ''), '::h[0-9a-f]{{16,17}}$', '') as symbol,
  regexp_replace(trim(raw_symbol), '\\+0x[0-9a-fA-F]+$', '') as variant from raw""",
)
def symbol_normalize(spark, sf_dir):
    raw = spark.sql(
        _RAW_SYMBOLS.replace("varchar", "string") + " from {part}", part=views.table(spark, sf_dir, "part")
    )
    return raw.select(
        "p_partkey",
        "raw_symbol",
        S.normalize_symbol(F.col("raw_symbol")).alias("symbol"),
        S.strip_address_offset(F.col("raw_symbol")).alias("variant"),
    )


_RAW_EVENTS = """
select case l_partkey % 9 when 0 then 'cycles' when 1 then 'cpu-cycles:u' when 2 then 'cpu_core/instructions/:ppp'
  when 3 then 'cpu_atom/cycles/' when 4 then 'task-clock:uH' when 5 then 'cpu-clock' when 6 then 'sched:sched_switch'
  when 7 then 'cpu/branch-misses/:k' else 'page-faults:x' end as event, l_quantity
"""


@query(
    "event_unit",
    f"""with raw as ({_RAW_EVENTS} from lineitem),
stripped as (select event, l_quantity, regexp_replace(event, '^(.*):[ukhGHpPSDWebR]+$', '\\1') as name from raw),
canon as (select event, l_quantity, case when name = 'cpu-cycles' then 'cycles' else regexp_replace(name,
  '^(?:cpu|cpu_core|cpu_atom)/(cycles|instructions|cache-references|cache-misses|branches|branch-misses)/$', '\\1')
  end as canonical_event from stripped)
select event, canonical_event, case when canonical_event in ('cpu-clock', 'task-clock') then 'nanoseconds'
  when canonical_event in ('cycles', 'instructions') then canonical_event else 'event_count' end as unit,
  cast(sum(cast(l_quantity as bigint)) as bigint) as weight from canon group by all""",
)
def event_unit(spark, sf_dir):
    raw = spark.sql(_RAW_EVENTS + " from {lineitem}", lineitem=views.table(spark, sf_dir, "lineitem"))
    event = F.col("event")
    return raw.groupBy(
        "event",
        S.canonical_perf_event(event).alias("canonical_event"),
        S.perf_period_unit(event).alias("unit"),
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("weight"))


_DUCK_FRAMES = f"""{views.DUCK_SAMPLES},
keyed as (select *, string_split(stack, ';') as syms from samples),
occ as (select k.*, u.pos, syms[u.pos] as symbol, case when u.pos = len(syms) then leaf_dso else 'unknown' end as dso
  from keyed k, lateral (select unnest(range(1, len(k.syms) + 1)) as pos) u),
flagged as (select *, pos = len(syms) as is_leaf,
  row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey, symbol, dso order by pos) = 1 as is_first
  from occ),
spots as (select capture_id, symbol, dso,
  cast(coalesce(sum(weight) filter (is_leaf), 0) as bigint) as self_weight,
  cast(sum(weight) filter (is_first) as bigint) as inclusive_weight,
  count(*) filter (is_first) as sample_count, count(*) as stack_occurrence_count,
  count(distinct thread_id) as thread_count from flagged group by capture_id, symbol, dso),
ranked as (select *, cast(row_number() over (partition by capture_id
    order by self_weight desc, inclusive_weight desc, symbol, dso) as int) as rank,
  sum(self_weight) over (partition by capture_id) as total from spots),
exported as (select capture_id, symbol, dso, self_weight, inclusive_weight, sample_count, stack_occurrence_count,
  thread_count, rank, 'H-' || lpad(cast(rank as varchar), cast(greatest(3, length(cast(rank as varchar))) as int), '0') as hotspot_id,
  round(self_weight * 100.0::double / total, 6) as self_percent,
  round(inclusive_weight * 100.0::double / total, 6) as inclusive_percent from ranked)
"""

_SPOT_COLUMNS = (
    "capture_id, symbol, dso, self_weight, inclusive_weight, sample_count, stack_occurrence_count, "
    "thread_count, rank, hotspot_id, self_percent, inclusive_percent"
)


def exported_hotspots(spark, sf_dir):
    return H.export_hotspots(H.hotspots(views.samples(spark, sf_dir)))


@query("hotspots", f"with {_DUCK_FRAMES} select {_SPOT_COLUMNS} from exported")
def hotspots(spark, sf_dir):
    return exported_hotspots(spark, sf_dir).selectExpr(*_SPOT_COLUMNS.split(", "))


@query(
    "hotspots_by_context",
    f"""with {views.DUCK_SAMPLES} select capture_id, sample_context, cast(sum(weight) as bigint) as self_weight,
    count(*) as samples, count(distinct string_split(stack, ';')[-1] || '|' || leaf_dso) as leaf_keys
    from samples group by all""",
)
def hotspots_by_context(spark, sf_dir):
    leaf = F.element_at("frames", -1)
    per_leaf = (
        views.samples(spark, sf_dir)
        .groupBy("capture_id", "sample_context", leaf["symbol"].alias("symbol"), leaf["dso"].alias("dso"))
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    )
    return per_leaf.groupBy("capture_id", "sample_context").agg(
        F.sum("weight").alias("self_weight"), F.sum("n").alias("samples"), F.count(F.lit(1)).alias("leaf_keys")
    )


_DUCK_PATHS = f"""{views.DUCK_SAMPLES},
paths as (select capture_id, list_transform(string_split(stack, ';'), lambda s, i:
    {{'symbol': s, 'dso': case when i = len(string_split(stack, ';')) then leaf_dso else 'unknown' end}}) as path,
  cast(sum(weight) as bigint) as weight, count(*) as record_count from samples group by all),
path_rank as (select *, cast(row_number() over (partition by capture_id order by weight desc, path) as int) as rank,
  sum(weight) over (partition by capture_id) as total from paths),
exported_paths as (select capture_id, path, weight, record_count, rank,
  'P-' || lpad(cast(rank as varchar), cast(greatest(3, length(cast(rank as varchar))) as int), '0') as path_id,
  round(weight * 100.0::double / total, 6) as percent from path_rank)
"""
_DUCK_PATH_TEXT = "array_to_string(list_transform(path, lambda f: f.symbol || '@' || f.dso), ';')"


def path_text(path="path"):
    return F.array_join(F.transform(path, lambda f: F.concat(f["symbol"], F.lit("@"), f["dso"])), ";")


def exported_call_paths(spark, sf_dir):
    return H.export_call_paths(H.call_paths(views.samples(spark, sf_dir)))


@query(
    "call_paths",
    f"""with {_DUCK_PATHS} select capture_id, path_id, {_DUCK_PATH_TEXT} as frames, weight, record_count, percent
    from exported_paths""",
)
def call_paths(spark, sf_dir):
    return exported_call_paths(spark, sf_dir).select(
        "capture_id", "path_id", path_text().alias("frames"), "weight", "record_count", "percent"
    )


# the objects a symbol is seen in stand for its raw spellings
def _variant_samples(spark, sf_dir):
    samples = views.samples(spark, sf_dir).drop("path")
    raw = F.concat(F.element_at("frames", -1)["dso"], F.lit("#"), F.pmod(F.col("sample_seq.l_partkey"), F.lit(50)))
    return samples.withColumn(
        "frames",
        F.transform("frames", lambda f: f.withField("dso", F.lit("unknown")).withField("raw_symbol", raw)),
    )


@query(
    "symbol_variants",
    f"""with {views.DUCK_SAMPLES},
occ as (select k.capture_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, u.pos, string_split(stack, ';')[u.pos] as symbol,
    leaf_dso || '#' || cast(l_partkey % 50 as varchar) as variant
  from samples k, lateral (select unnest(range(1, len(string_split(k.stack, ';')) + 1)) as pos) u),
seen as (select capture_id, symbol, variant, min((l_orderkey, l_linenumber, l_partkey, l_suppkey, pos)) as seen
  from occ group by all),
numbered as (select *, row_number() over (partition by capture_id, symbol order by seen, variant) as rn from seen)
select capture_id, symbol, 'unknown' as dso, array_to_string(list_sort(list(variant)), ',') as variants,
  cast(count(*) as int) as symbol_variant_count, false as symbol_variants_truncated,
  count(*) > 1 as normalization_merged from numbered group by capture_id, symbol""",
)
def symbol_variants(spark, sf_dir):
    rows = H.symbol_variants(_variant_samples(spark, sf_dir))
    return rows.select(
        *H.KEY,
        F.array_join("symbol_variants", ",").alias("variants"),
        "symbol_variant_count",
        "symbol_variants_truncated",
        "normalization_merged",
    )


def mixed_samples(spark, sf_dir, kept=False):
    """Samples whose candidate side holds a second event, and whose leaf is unknown at every tenth weight."""
    rows = views.samples(spark, sf_dir, kept)
    second = (F.col("capture_id") == "candidate") & (F.col("sample_seq.l_linenumber") == 7)
    leaf = F.element_at("frames", -1).withField("is_unknown", F.col("weight") % 10 == 0)
    frames = F.concat(F.slice("frames", 1, F.size("frames") - 1), F.array(leaf))
    return rows.withColumn("event", F.when(second, "other").otherwise(F.col("event"))).withColumn("frames", frames)


@query(
    "profile_totals",
    f"""with {views.DUCK_SAMPLES} select capture_id, cast(sum(weight) as bigint) as total_weight, count(*) as record_count,
  bool_or(stack like '%;%') as has_call_graph, not bool_or(capture_id = 'candidate' and l_linenumber = 7) as scope_unique,
  cast(coalesce(sum(weight) filter (stack like '%;%'), 0) as bigint) as call_graph_weight,
  cast(coalesce(sum(weight) filter (sample_context = 'kernel'), 0) as bigint) as kernel_context_self_weight,
  cast(coalesce(sum(weight) filter (sample_context = 'user'), 0) as bigint) as user_context_self_weight,
  cast(coalesce(sum(weight) filter (sample_context = 'unknown'), 0) as bigint) as unknown_context_self_weight,
  cast(coalesce(sum(weight) filter (weight % 10 = 0), 0) as bigint) as unknown_self_weight,
  cast(coalesce(sum(weight) filter (weight % 10 = 0 and sample_context = 'kernel'), 0) as bigint) as unresolved_kernel_self_weight,
  cast(coalesce(sum(weight) filter (weight % 10 = 0 and sample_context = 'user'), 0) as bigint) as unresolved_user_self_weight,
  cast(sum(len(string_split(stack, ';'))) as bigint) as total_frame_count from samples group by capture_id""",
)
def profile_totals(spark, sf_dir):
    return H.profile_totals(mixed_samples(spark, sf_dir)).select(
        "capture_id",
        "total_weight",
        "record_count",
        "has_call_graph",
        "scope_unique",
        "call_graph_weight",
        "kernel_context_self_weight",
        "user_context_self_weight",
        "unknown_context_self_weight",
        "unknown_self_weight",
        "unresolved_kernel_self_weight",
        "unresolved_user_self_weight",
        "total_frame_count",
    )
