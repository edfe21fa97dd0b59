"""Queries over runtime-lock streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import compare as P
from gristmill.operators import pages as G
from gristmill.operators import runtime_locks as R
from gristmill.operators.ordered import cut
from gristmill.plans import views
from gristmill.plans.registry import query
from gristmill.plans.replay_sql import replay_sql
from gristmill.plans.trace_queries import _PRE, dist_sql

_KEY = "capture_id, context, lock_key, lock_kind"
_DUCK_REPLAY = f"""{views.DUCK_RUNTIME},
sub as (select *, stack_id as st from rt where event_kind in ('wait_begin', 'wait_end', 'acquire', 'release')
  union all by name select capture_id, context, lock_key, lock_kind, min(lock_id) as lock_id, max(event_index) + 1 as event_index, 'end' as event_kind
    from rt where event_kind in ('wait_begin', 'wait_end', 'acquire', 'release') group by all),
sg as (select *, count(*) filter (event_kind in ('wait_end', 'acquire')) over w as cb, count(*) filter (event_kind = 'release') over w as cr,
  last_value(case when event_kind = 'wait_begin' then coalesce(stack_id, '-') end ignore nulls) over w as b_st,
  last_value(case when event_kind = 'wait_begin' then coalesce(owner_context, '-') end ignore nulls) over w as b_own,
  last_value(case when event_kind = 'acquire' then coalesce(stack_id, '-') end ignore nulls) over w as a_st,
  last_value(case when event_kind = 'wait_begin' then ts_ns end ignore nulls) over w as lb_ts,
  last_value(case when event_kind = 'wait_begin' then event_id end ignore nulls) over w as lb_id,
  last_value(case when event_kind = 'acquire' then ts_ns end ignore nulls) over w as la_ts,
  last_value(case when event_kind = 'acquire' then event_id end ignore nulls) over w as la_id
  from sub window w as (partition by {_KEY} order by event_index {_PRE})),
ss as (select *, count(*) filter (event_kind = 'wait_begin') over (partition by {_KEY}, cb order by event_index {_PRE}) % 2 = 1 as pend,
  count(*) filter (event_kind = 'acquire') over (partition by {_KEY}, cr order by event_index {_PRE}) % 2 = 1 as act from sg),
pk0 as (select *, case when event_kind = 'park' then context else parked_context end as pc from rt where event_kind in ('park', 'unpark') and (event_kind = 'park' or parked_context is not null)),
pk1 as (select * from pk0 union all by name select capture_id, pc, lock_key, lock_kind, min(lock_id) as lock_id, max(event_index) + 1 as event_index, 'end' as event_kind from pk0 group by all),
pk2 as (select *, count(*) filter (event_kind = 'unpark') over w as cu,
  last_value(case when event_kind = 'park' then ts_ns end ignore nulls) over w as p_ts, last_value(case when event_kind = 'park' then event_id end ignore nulls) over w as p_id,
  last_value(case when event_kind = 'park' then coalesce(stack_id, '-') end ignore nulls) over w as p_st,
  last_value(case when event_kind = 'park' then coalesce(owner_context, '-') end ignore nulls) over w as p_own
  from pk1 window w as (partition by capture_id, pc, lock_key, lock_kind order by event_index {_PRE})),
pk as (select *, count(*) filter (event_kind = 'park') over (partition by capture_id, pc, lock_key, lock_kind, cu order by event_index {_PRE}) % 2 = 1 as parked from pk2),
waits as (
  select capture_id, context, lock_id, lock_kind, coalesce(stack_id, nullif(b_st, '-')) as stack_id, semantics, duration_ns, outcome,
    b_own <> '-' or owner_context is not null as owner_observed, lb_id as begin_event_id, event_id as end_event_id
    from ss where event_kind = 'wait_end' and pend and ts_ns - lb_ts = duration_ns
  union all select capture_id, context, lock_id, lock_kind, stack_id, semantics, duration_ns, outcome, owner_context is not null, null, event_id
    from ss where event_kind = 'wait_end' and not pend and semantics = 'thresholded'
  union all select capture_id, context, lock_id, lock_kind, coalesce(stack_id, nullif(b_st, '-')), semantics, ts_ns - lb_ts, 'acquired',
    b_own <> '-' or owner_context is not null, lb_id, event_id from ss where event_kind = 'acquire' and pend
  union all select capture_id, parked_context, lock_id, lock_kind, coalesce(stack_id, nullif(p_st, '-')), semantics, ts_ns - p_ts, 'unparked',
    p_own <> '-' or owner_context is not null, p_id, event_id from pk where event_kind = 'unpark' and parked),
holds as (select capture_id, context, lock_id, lock_kind, coalesce(stack_id, nullif(a_st, '-')) as stack_id, hold_duration_ns as duration_ns,
  la_id as acquire_event_id, event_id as release_event_id from ss where event_kind = 'release' and act and semantics = 'exact'
  and hold_duration_ns = ts_ns - la_ts),
profs as (select * from rt where event_kind = 'sampled_contention'),
iss as (
  select capture_id, 'wait' as phase, 'duplicate_wait_begin' as reason, lb_id as s, event_id as r from ss where event_kind = 'wait_begin' and pend
  union all select capture_id, 'wait', 'wait_end_without_begin', event_id, null from ss where event_kind = 'wait_end' and not pend and semantics <> 'thresholded'
  union all select capture_id, 'wait', 'wait_duration_mismatch', event_id, lb_id from ss where event_kind = 'wait_end' and pend and ts_ns - lb_ts <> duration_ns
  union all select capture_id, 'hold', 'duplicate_acquire', la_id, event_id from ss where event_kind = 'acquire' and act
  union all select capture_id, 'hold', 'release_without_acquire', event_id, null from ss where event_kind = 'release' and not act
  union all select capture_id, 'hold', 'hold_duration_mismatch', event_id, la_id from ss where event_kind = 'release' and act and hold_duration_ns <> ts_ns - la_ts
  union all select capture_id, 'wait', 'trace_end_boundary', lb_id, null from ss where event_kind = 'end' and pend
  union all select capture_id, 'hold', 'trace_end_boundary', la_id, null from ss where event_kind = 'end' and act
  union all select capture_id, 'park', 'duplicate_wait_begin', p_id, event_id from pk where event_kind = 'park' and parked
  union all select capture_id, 'park', 'unpark_without_park', event_id, null from pk where event_kind = 'unpark' and not parked
  union all select capture_id, 'park', 'unpark_without_park', event_id, null from rt where event_kind = 'unpark' and parked_context is null
  union all select capture_id, 'park', 'trace_end_boundary', p_id, null from pk where event_kind = 'end' and parked),
obs as (select capture_id, context, lock_id, lock_kind, stack_id, case when semantics = 'exact' then 'exact_wait' else 'thresholded_wait' end as measure,
    duration_ns, duration_ns as wait_ns, outcome, case when owner_observed then 1 else 0 end as own, 0 as cnt from waits
  union all select capture_id, context, lock_id, lock_kind, stack_id, 'exact_hold', duration_ns, 0, 'acquired', 0, 0 from holds
  union all select capture_id, context, lock_id, lock_kind, stack_id, 'sampled', null, cumulative_wait_ns, 'unknown', 0, observed_count from profs),
fo as (select * replace (coalesce(lock_id, '~aggregate') as lock_id, coalesce(stack_id, '~unknown') as stack_id) from obs)
"""

_METRICS = f"""cast(coalesce(sum(cnt) filter (measure = 'sampled'), 0) as bigint) as sampled_observation_count,
  cast(0 as bigint) as cumulative_observation_count, cast(sum(wait_ns) as bigint) as observed_or_estimated_wait_ns,
  cast(sum(own) as bigint) as owner_observed_count,
  {dist_sql('exact_wait', 'duration_ns', "measure = 'exact_wait'", '0')}, {dist_sql('thresholded_wait', 'duration_ns', "measure = 'thresholded_wait'", '0')},
  {dist_sql('exact_hold', 'duration_ns', "measure = 'exact_hold'", '0')},
  cast(count(*) filter (measure in ('exact_wait', 'thresholded_wait')) + coalesce(sum(cnt) filter (measure = 'sampled'), 0) as bigint) as observation_count"""


def replayed(spark, sf_dir, references=False):
    return R.replay(views.runtime_lock_events(spark, sf_dir, references))


def observed(spark, sf_dir):
    return cut(R.observations(replayed(spark, sf_dir)))


@query(
    "rt_waits",
    f"with {_DUCK_REPLAY} select * replace (cast(begin_event_id as varchar) as begin_event_id, cast(end_event_id as varchar) as end_event_id) from waits",
)
def rt_waits(spark, sf_dir):
    return replayed(spark, sf_dir).waits


@query(
    "rt_holds",
    f"with {_DUCK_REPLAY} select * replace (cast(acquire_event_id as varchar) as acquire_event_id, cast(release_event_id as varchar) as release_event_id) from holds",
)
def rt_holds(spark, sf_dir):
    return replayed(spark, sf_dir).holds


@query(
    "rt_issues",
    f"with {_DUCK_REPLAY} select capture_id, phase, reason, cast(s as varchar) as subject_id, cast(r as varchar) as related_id from iss",
)
def rt_issues(spark, sf_dir):
    return replayed(spark, sf_dir).issues.select("capture_id", "phase", "reason", "subject_id", "related_id")


@query(
    "rt_dispositions",
    f"""with {_DUCK_REPLAY}, u as (select capture_id, begin_event_id as e from waits union select capture_id, end_event_id from waits
  union select capture_id, event_id from profs union select capture_id, acquire_event_id from holds union select capture_id, release_event_id from holds
  union select capture_id, la_id from ss where event_kind = 'release' and act and hold_duration_ns = ts_ns - la_ts
  union select capture_id, event_id from ss where event_kind = 'release' and act and hold_duration_ns = ts_ns - la_ts),
v as (select capture_id, s as e from iss union select capture_id, r from iss)
select rt.capture_id, event_kind, case when u.e is not null then 'consumed' when v.e is not null then 'unpaired' else 'ignored' end as disposition,
  count(*) as events from rt left join u on rt.capture_id = u.capture_id and rt.event_id = u.e left join v on rt.capture_id = v.capture_id and rt.event_id = v.e group by all""",
)
def rt_dispositions(spark, sf_dir):
    return (
        replayed(spark, sf_dir)
        .dispositions.groupBy("capture_id", "event_kind", "disposition")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def _projection_sql(keys, extra):
    return f"with {_DUCK_REPLAY} select capture_id, {keys}, {_METRICS}, {extra} from fo group by capture_id, {keys}"


_LOCKS = "case when bool_or(lock_id = '~aggregate') then null else count(distinct lock_id || '|' || lock_kind) end as lock_count"
_CONTEXTS = "count(distinct context) as execution_context_count"


@query("rt_by_lock", _projection_sql("lock_id, lock_kind", "count(distinct context) filter (measure <> 'exact_hold') as waiter_context_count"))
def rt_by_lock(spark, sf_dir):
    return R.projection(observed(spark, sf_dir), "lock")


@query("rt_by_context", _projection_sql("context", _LOCKS))
def rt_by_context(spark, sf_dir):
    return R.projection(observed(spark, sf_dir), "execution_context")


@query("rt_by_stack", _projection_sql("stack_id", f"{_LOCKS}, {_CONTEXTS}"))
def rt_by_stack(spark, sf_dir):
    return R.projection(observed(spark, sf_dir), "call_path")


@query("rt_by_outcome", _projection_sql("outcome", f"{_LOCKS}, {_CONTEXTS}"))
def rt_by_outcome(spark, sf_dir):
    return R.projection(observed(spark, sf_dir), "wait_outcome")


@query("rt_by_kind", _projection_sql("lock_kind", f"{_LOCKS}, {_CONTEXTS}"))
def rt_by_kind(spark, sf_dir):
    return R.projection(observed(spark, sf_dir), "lock_kind")


@query("rt_totals", f"with {_DUCK_REPLAY} select capture_id, {_METRICS} from fo group by capture_id")
def rt_totals(spark, sf_dir):
    return R.totals(observed(spark, sf_dir))


@query(
    "rt_top_stacks",
    f"""with {_DUCK_REPLAY}, w as (select capture_id, lock_id, lock_kind, stack_id,
  cast(sum(case when measure = 'exact_hold' then duration_ns else wait_ns end) as bigint) as weight_ns from fo where stack_id <> '~unknown' group by all),
r as (select *, cast(row_number() over (partition by capture_id, lock_id, lock_kind order by weight_ns desc, stack_id) as int) as position from w)
select * from r where position <= 2""",
)
def rt_top_stacks(spark, sf_dir):
    return R.top_stacks(observed(spark, sf_dir), 2)


@query(
    "rt_coverage",
    f"""with {_DUCK_REPLAY}, p as (select capture_id, context, {_METRICS} from fo group by capture_id, context),
r as (select *, row_number() over (partition by capture_id order by observed_or_estimated_wait_ns desc, exact_hold_total_ns desc, observation_count desc, context) as rank from p)
select capture_id, count(*) as total_row_count, count(*) filter (rank <= 1) as exported_row_count, count(*) filter (rank > 1) as omitted_row_count,
  {", ".join(f"cast(coalesce(sum({c}) filter (rank > 1), 0) as bigint) as omitted_{n}" for n, c in R.COVERAGE_SUMS.items())}
from r group by capture_id""",
)
def rt_coverage(spark, sf_dir):
    rows = cut(R.metrics_by(observed(spark, sf_dir), ["context"]))
    return R.coverage(rows, "execution_context", 1)


@query(
    "rt_conservation",
    f"""with {_DUCK_REPLAY} select capture_id, unnest({list(R.PROJECTIONS)}) as projection, true as passed from (select distinct capture_id from obs)""",
)
def rt_conservation(spark, sf_dir):
    return R.conservation(observed(spark, sf_dir), 2)


@query(
    "rt_lock_page",
    f"""with {_DUCK_REPLAY}, p as (select capture_id, lock_id, lock_kind, {_METRICS} from fo group by capture_id, lock_id, lock_kind),
r as (select *, row_number() over (partition by capture_id order by exact_hold_total_ns desc, lock_id, lock_kind) - 1 as position,
  count(*) over (partition by capture_id) as total_items from p)
select capture_id, lock_id, lock_kind, exact_hold_total_ns as exact_hold_ns, cast(position as int) as position, total_items,
  case when 3 < total_items then 3 end as next_cursor from r where position >= 1 and position < 3""",
)
def rt_lock_page(spark, sf_dir):
    rows = R.metrics_by(observed(spark, sf_dir), ["lock_id", "lock_kind"]).withColumnRenamed(
        "exact_hold_total_ns", "exact_hold_ns"
    )
    return G.lock_page(rows, ["lock_id", "lock_kind"], "exact_hold_ns", 1, 2).select(
        "capture_id", "lock_id", "lock_kind", "exact_hold_ns", "position", "total_items", "next_cursor"
    )


@query(
    "rt_ordinals",
    f"""with {views.DUCK_RUNTIME}, s as (select capture_id, stack_id, min(event_index) as i from rt where stack_id is not null group by all)
select capture_id, stack_id, row_number() over (partition by capture_id order by i) - 1 as ordinal from s""",
)
def rt_ordinals(spark, sf_dir):
    return R.first_seen_ordinals(views.runtime_lock_events(spark, sf_dir), "stack_id")


# acquire / release nesting per context; each release claims the acquire that was last
@query(
    "lifo_pairs",
    f"""with {views.DUCK_RUNTIME}, e as (select capture_id, context, event_index, event_id, case event_kind when 'acquire' then 1 else -1 end as step,
  case when event_kind = 'release' then a_id end as ref_id from rt where event_kind in ('acquire', 'release')),
d as (select *, sum(step) over (partition by capture_id, context order by event_index) as depth from e),
l as (select *, case when step > 0 then depth else depth + 1 end as level from d),
p as (select *, last_value(case when step > 0 then event_id end ignore nulls) over (partition by capture_id, context, level order by event_index {_PRE}) as partner from l)
select capture_id, context, event_index, event_id, case when step < 0 then partner end as partner_id,
  step < 0 and (depth < 0 or partner is distinct from ref_id) as violation from p""",
)
def lifo_pairs(spark, sf_dir):
    kind = F.col("event_kind")
    from gristmill.operators.ordered import running, running_last

    rows = views.runtime_lock_events(spark, sf_dir).withColumn("lock_key", F.coalesce("lock_id", F.lit("")))
    rows = running(
        rows,
        ["capture_id", "context", "lock_key", "lock_kind"],
        "event_index",
        {"taken": running_last(F.when(kind == "acquire", F.col("event_id")), inclusive=False)},
    )
    events = rows.where(kind.isin("acquire", "release")).select(
        "capture_id",
        "context",
        "event_index",
        "event_id",
        F.when(kind == "acquire", 1).otherwise(-1).alias("step"),
        F.when(kind == "release", F.col("taken")).alias("ref_id"),
    )
    return R.lifo_pairs(events, ["capture_id", "context"]).select(
        "capture_id", "context", "event_index", "event_id", "partner_id", "violation"
    )


@query(
    "rt_compare",
    f"""with {_DUCK_REPLAY}, t as (select capture_id, cast(coalesce(sum(duration_ns) filter (measure = 'exact_hold'), 0) as bigint) as total_exact_hold_ns,
  cast(coalesce(sum(duration_ns) filter (measure = 'exact_wait'), 0) as bigint) as total_exact_wait_ns from obs where capture_id < 3 group by all),
m as (select capture_id, 'total_exact_hold_ns' as metric, total_exact_hold_ns as v from t union all select capture_id, 'total_exact_wait_ns', total_exact_wait_ns from t),
d as (select c.capture_id as pair_id, b.metric, b.v as b, c.v as c, case when b.v = c.v then 0.0::double when b.v = 0 then 100.0::double
  else (c.v::double - b.v) / b.v * 100 end as ch from m b join m c on c.capture_id = b.capture_id + 1 and b.metric = c.metric)
select pair_id, metric, b as baseline_value, c as candidate_value, round(ch, 6) as change_percent, case when ch <= -1 then 'candidate_improvement'
  when ch >= 1 then 'candidate_regression' else 'no_material_change' end as status from d""",
)
def rt_compare(spark, sf_dir):
    rows = R.totals(observed(spark, sf_dir)).select(
        "capture_id",
        F.expr(views.RUNTIME_SEMANTICS).alias("semantics"),
        F.col("exact_hold_total_ns").alias("total_exact_hold_ns"),
        F.col("exact_wait_total_ns").alias("total_exact_wait_ns"),
        F.col("thresholded_wait_total_ns").alias("total_thresholded_wait_ns"),
        F.col("observed_or_estimated_wait_ns").alias("total_observed_or_estimated_wait_ns"),
        F.col("sampled_observation_count").alias("total_sampled_observation_count"),
        F.col("cumulative_observation_count").alias("total_cumulative_observation_count"),
    )
    # every capture against the one before it; only pairs that share a metric compare
    metrics = P.runtime_lock_metrics(rows, ["capture_id"])
    before = metrics.withColumn("pair_id", F.col("capture_id") + 1)
    changes = P.runtime_lock_changes(before, metrics.withColumn("pair_id", F.col("capture_id")), ["pair_id"])
    return changes.select(
        "pair_id", "metric", "baseline_value", "candidate_value", F.round("change_percent", 6).alias("change_percent"), "status"
    )


@query(
    "rt_referenced",
    f"""with recursive {_DUCK_REPLAY.replace(views.DUCK_RUNTIME, views.DUCK_REFERENCED)}, {replay_sql('referenced')}
select capture_id, phase, reason, subject_id, related_id from rp_issues
union all select capture_id, phase, reason, cast(s as varchar), cast(r as varchar) from iss where phase = 'park'""",
)
def rt_referenced(spark, sf_dir):
    """Replay of streams whose rows name each other, with nested locks; the twin is a second replay."""
    result = replayed(spark, sf_dir, references=True)
    return result.issues.select("capture_id", "phase", "reason", "subject_id", "related_id")
