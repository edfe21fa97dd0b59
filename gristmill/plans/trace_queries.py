"""Queries over scheduler and lock event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import locks as L
from gristmill.operators import sched as R
from gristmill.plans import views
from gristmill.plans.registry import query

_PRE = "rows between unbounded preceding and 1 preceding"


def dist_sql(prefix: str, value: str, condition: str = "true", empty: str = "null") -> str:
    """One distribution as SQL aggregates (nearest rank = percentile_disc)."""
    f = f"filter ({condition} and {value} is not null)"
    parts = [
        f"count({value}) {f} as {prefix}_sample_count",
        f"cast(coalesce(sum({value}) {f}, 0) as bigint) as {prefix}_total_ns",
        f"cast(coalesce(min({value}) {f}, 0) as bigint) as {prefix}_minimum_ns",
        f"cast(coalesce(sum({value}) {f} // count({value}) {f}, 0) as bigint) as {prefix}_mean_ns",
    ]
    for p in (50, 95, 99):
        parts.append(
            f"cast(coalesce(percentile_disc({p / 100}) within group (order by {value}) {f}, {empty}) as bigint) as {prefix}_p{p}_ns"
        )
    parts.append(f"cast(coalesce(max({value}) {f}, {empty}) as bigint) as {prefix}_max_ns")
    return ", ".join(parts)


_DUCK_STEPS = f"""{views.DUCK_SCHED},
ev as (select capture_id, tid, event_index, event_id, ts_ns, cpu, event_type, state from sched
    where event_type <> 'waking'
  union all select capture_id, tid, max(event_index) + 1, null, null, null, 'end', null from sched
    where event_type <> 'waking' group by capture_id, tid),
fl as (select *, count(*) filter (event_type = 'switch_out') over w as ob,
    count(*) filter (event_type in ('switch_in', 'switch_out')) over w as sb from ev
  window w as (partition by capture_id, tid order by event_index {_PRE})),
mk as (select *,
    count(*) filter (event_type = 'switch_in') over (partition by capture_id, tid, ob order by event_index {_PRE}) as runs,
    count(*) filter (event_type = 'wakeup') over (partition by capture_id, tid, sb order by event_index {_PRE}) as gap,
    last_value(case when event_type in ('switch_in', 'switch_out') then event_type end ignore nulls) over w as b_type,
    last_value(case when event_type in ('switch_in', 'switch_out') then ts_ns end ignore nulls) over w as b_ts,
    last_value(case when event_type in ('switch_in', 'switch_out') then event_id end ignore nulls) over w as b_id,
    last_value(case when event_type in ('switch_in', 'switch_out') then state end ignore nulls) over w as b_state,
    last_value(case when event_type = 'wakeup' then ts_ns end ignore nulls) over w as w_ts,
    last_value(case when event_type = 'wakeup' then event_id end ignore nulls) over w as w_id
  from fl window w as (partition by capture_id, tid order by event_index {_PRE})),
st as (select *,
    gap + coalesce(last_value(case when event_type in ('switch_in', 'switch_out') then
      case when event_type = 'switch_in' and runs % 2 = 1 then gap else 0 end end ignore nulls) over w, 0) as wakes,
    last_value(case when (event_type = 'switch_out' and runs % 2 = 1) or event_type = 'migrate' then cpu end ignore nulls)
      over w as run_cpu,
    coalesce(b_type = 'switch_out', false) as was_off,
    event_type = 'switch_in' and runs % 2 = 0 as eff
  from mk where event_type <> 'wakeup'
  window w as (partition by capture_id, tid order by event_index {_PRE})),
run_i as (select capture_id, tid, b_ts as switch_in_ns, ts_ns as switch_out_ns, ts_ns - b_ts as duration_ns,
    b_id as switch_in_event_id, event_id as switch_out_event_id from st where event_type = 'switch_out' and runs % 2 = 1),
lat_i as (select capture_id, tid, w_ts as wakeup_ns, ts_ns as switch_in_ns, ts_ns - w_ts as duration_ns,
    w_id as wakeup_event_id, event_id as switch_in_event_id from st where eff and wakes = 1),
off_i as (select capture_id, tid, case when was_off then b_ts end as switch_out_ns, case when wakes = 1 then w_ts end as wakeup_ns,
    case when eff then ts_ns end as switch_in_ns,
    case when eff and was_off then ts_ns - b_ts end as total_ns,
    case when eff and was_off and wakes = 1 then w_ts - b_ts end as blocked_ns,
    case when eff and was_off and wakes = 1 then ts_ns - w_ts end as runnable_ns,
    case when eff and was_off then case when wakes = 1 then 0 else ts_ns - b_ts end end as unknown_ns,
    case when not eff and was_off and wakes = 1 then w_ts - b_ts end as blocked_prefix_ns,
    case when eff and not was_off and wakes = 1 then ts_ns - w_ts end as runnable_suffix_ns,
    case when was_off then b_state end as previous_state,
    case when was_off and b_state in ('interruptible_sleep', 'parked', 'stopped', 'S') then 'sleep' else 'unknown' end as category,
    eff and was_off as complete, eff and was_off and wakes = 1 as split_complete,
    case when event_type = 'switch_out' then 'overlapping_switch_out' when event_type = 'end' then 'trace_end_boundary'
      when not was_off then 'trace_start_boundary' when wakes = 0 then 'missing_wakeup'
      when wakes > 1 then 'duplicate_wakeup' end as incomplete_reason,
    case when was_off then b_id end as switch_out_event_id, wakes as wakeup_count,
    case when wakes = 1 then w_id end as wakeup_event_id, case when eff then event_id end as switch_in_event_id
  from st where (event_type = 'switch_out' and was_off) or eff or (event_type = 'end' and (was_off or wakes > 0)))
"""

_OFF = (
    "capture_id, tid, switch_out_ns, wakeup_ns, switch_in_ns, total_ns, blocked_ns, runnable_ns, unknown_ns, "
    "blocked_prefix_ns, runnable_suffix_ns, previous_state, category, complete, split_complete, incomplete_reason, "
    "switch_out_event_id, wakeup_count, wakeup_event_id, switch_in_event_id"
)


def steps(spark, sf_dir):
    return R.transitions(views.sched_events(spark, sf_dir))


@query("sched_runtime", f"with {_DUCK_STEPS} select * from run_i")
def sched_runtime(spark, sf_dir):
    return R.runtime_intervals(steps(spark, sf_dir))


@query("sched_latency", f"with {_DUCK_STEPS} select * from lat_i")
def sched_latency(spark, sf_dir):
    return R.runnable_latencies(steps(spark, sf_dir)).drop("waker_tid")


@query("off_cpu", f"with {_DUCK_STEPS} select {_OFF} from off_i")
def off_cpu(spark, sf_dir):
    return R.off_cpu_intervals(steps(spark, sf_dir)).drop("waker_tid")


@query(
    "migrations",
    f"""with {_DUCK_STEPS} select capture_id, tid, event_index, event_type, cpu, run_cpu from st
    where event_type = 'migrate' or (eff and coalesce(run_cpu <> cpu, false))""",
)
def migrations(spark, sf_dir):
    return (
        steps(spark, sf_dir)
        .where(R.migrated())
        .select("capture_id", "tid", "event_index", "event_type", "cpu", "run_cpu")
    )


@query(
    "sched_threads",
    f"""with {_DUCK_STEPS}, c as (select capture_id, tid, count(*) filter (event_type = 'switch_in') as switch_in_count,
    count(*) filter (event_type = 'switch_out') as switch_out_count,
    count(*) filter (event_type = 'migrate' or (eff and coalesce(run_cpu <> cpu, false))) as migration_count,
    cast(sum(case event_type
      when 'switch_out' then case when runs % 2 = 0 then 1 else 0 end + case when was_off then 1 else 0 end
      when 'switch_in' then case when not eff then 1 else case when wakes > 1 then 1 else 0 end
        + case when not was_off or wakes = 0 then 1 else 0 end end
      when 'end' then case when runs % 2 = 1 then 1 else 0 end + case when was_off or wakes > 0 then 1 else 0 end
      else 0 end) as bigint) as incomplete_transition_count from st group by capture_id, tid),
m as (select capture_id, tid, duration_ns as rt, null as lt from run_i union all select capture_id, tid, null, duration_ns from lat_i),
d as (select c.capture_id, c.tid, {dist_sql('runtime', 'rt')}, {dist_sql('runnable', 'lt')}
  from c left join m on c.capture_id = m.capture_id and c.tid = m.tid group by c.capture_id, c.tid)
select c.*, d.* exclude (capture_id, tid) from c join d on c.capture_id = d.capture_id and c.tid = d.tid""",
)
def sched_threads(spark, sf_dir):
    return R.thread_summary(steps(spark, sf_dir))


@query(
    "off_cpu_threads",
    f"""with {_DUCK_STEPS}, th as (select distinct capture_id, tid from st)
select th.capture_id, th.tid, count(*) filter (complete) as complete_count,
  count(*) filter (split_complete) as split_complete_count, count(*) filter (not complete) as incomplete_count,
  count(*) filter (complete and category = 'sleep') as sleep_count,
  count(*) filter (complete and category = 'unknown') as unknown_category_count,
  {dist_sql('off_cpu', 'total_ns')}, {dist_sql('blocked', 'blocked_ns')}, {dist_sql('runnable', 'runnable_ns')},
  {dist_sql('unknown', 'unknown_ns', 'complete and not split_complete')}
from th left join off_i o on th.capture_id = o.capture_id and th.tid = o.tid group by th.capture_id, th.tid""",
)
def off_cpu_threads(spark, sf_dir):
    return R.off_cpu_summary(steps(spark, sf_dir))


@query(
    "worst_off_cpu",
    f"""with {_DUCK_STEPS}, r as (select *, cast(row_number() over (partition by capture_id order by coalesce(total_ns, -1) desc, tid,
    coalesce(switch_out_ns, -1), coalesce(cast(switch_out_event_id as varchar), cast(switch_in_event_id as varchar), '')) as int) as rank
  from off_i) select {_OFF}, rank from r where rank <= 100""",
)
def worst_off_cpu(spark, sf_dir):
    return R.worst_off_cpu(R.off_cpu_intervals(steps(spark, sf_dir))).drop("waker_tid")


@query(
    "worst_runs",
    f"""with {_DUCK_STEPS}, a as (select 'runtime' as measure, capture_id, tid, duration_ns, switch_in_ns as start_ns,
    switch_in_event_id as start_event_id from run_i union all
  select 'runnable', capture_id, tid, duration_ns, wakeup_ns, wakeup_event_id from lat_i),
r as (select *, cast(row_number() over (partition by measure, capture_id order by duration_ns desc, tid, start_ns,
  cast(start_event_id as varchar)) as int) as rank from a) select * from r where rank <= 100""",
)
def worst_runs(spark, sf_dir):
    s = steps(spark, sf_dir)
    common = ["capture_id", "tid", "duration_ns"]
    runs = R.worst_runtime(R.runtime_intervals(s)).select(
        F.lit("runtime").alias("measure"), *common, F.col("switch_in_ns").alias("start_ns"),
        F.col("switch_in_event_id").alias("start_event_id"), "rank",
    )
    waits = R.worst_runnable(R.runnable_latencies(s)).select(
        F.lit("runnable").alias("measure"), *common, F.col("wakeup_ns").alias("start_ns"),
        F.col("wakeup_event_id").alias("start_event_id"), "rank",
    )
    return runs.unionByName(waits)


@query(
    "trace_dispositions",
    f"""with {_DUCK_STEPS}, used as (select capture_id, switch_in_event_id as event_id from run_i
  union select capture_id, switch_out_event_id from run_i union select capture_id, wakeup_event_id from lat_i
  union select capture_id, switch_in_event_id from lat_i union select capture_id, switch_out_event_id from off_i where complete
  union select capture_id, switch_in_event_id from off_i where complete
  union select capture_id, wakeup_event_id from off_i where split_complete)
select s.capture_id, case when event_type = 'waking' then 'ignored' when u.event_id is not null or event_type = 'migrate'
  then 'consumed' else 'unpaired' end as disposition, count(*) as events
from sched s left join used u on s.capture_id = u.capture_id and s.event_id = u.event_id group by all""",
)
def trace_dispositions(spark, sf_dir):
    events = views.sched_events(spark, sf_dir)
    marked = R.dispositions(events, R.transitions(events))
    return marked.groupBy("capture_id", "disposition").agg(F.count(F.lit(1)).alias("events"))


# every 97th event stands for a lost record; a waking row names the thread on its cpu as waker
_LOST = "event_id % 97 = 0"


def _with_lost(spark, sf_dir):
    events = views.sched_events(spark, sf_dir).withColumn(
        "event_type", F.when(F.expr(_LOST), "lost").otherwise(F.col("event_type"))
    )
    return events.withColumn("waker_tid", F.when(F.col("event_type") == "waking", F.col("cpu").cast("bigint")))


@query(
    "waker_enrich",
    f"""with {views.DUCK_SCHED}, e as (select *, case when {_LOST} then 'lost' else event_type end as kind from sched),
f as (select *, count(*) filter (kind = 'lost') over (partition by capture_id order by event_index) as epoch from e),
g as (select *, count(*) filter (kind = 'wakeup') over (partition by capture_id, tid, epoch order by event_index {_PRE}) as seg
  from f where kind in ('waking', 'wakeup')),
h as (select *, count(*) filter (kind = 'waking') over w as pending,
    last_value(case when kind = 'waking' then event_id end ignore nulls) over w as wid,
    last_value(case when kind = 'waking' then cpu end ignore nulls) over w as wcpu
  from g window w as (partition by capture_id, tid, epoch, seg order by event_index {_PRE}))
select capture_id, tid, event_index, event_id, cast(case when pending = 1 then wcpu end as bigint) as waker_tid,
  case when pending = 1 then wid end as waking_event_id, pending, pending > 1 as ambiguous from h where kind = 'wakeup'""",
)
def waker_enrich(spark, sf_dir):
    rows = R.enrich_wakers(R.lost_epochs(_with_lost(spark, sf_dir)))
    return rows.select(
        "capture_id", "tid", "event_index", "event_id", "waker_tid", "waking_event_id", "pending", "ambiguous"
    )


# arrival order = event id: time then runs backwards often
@query(
    "late_rows",
    f"""with {views.DUCK_SCHED}, a as (select *, coalesce(ts_ns < max(ts_ns) over (partition by capture_id order by event_id {_PRE}), false)
  as late from sched) select capture_id, event_type, late, count(*) as events, cast(sum(ts_ns % 1000000007) as bigint) as check_sum from a group by all""",
)
def late_rows(spark, sf_dir):
    arrivals = views.sched_events(spark, sf_dir).withColumn("event_index", F.col("event_id"))
    return (
        R.drop_late(arrivals)
        .groupBy("capture_id", "event_type", "late")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("ts_ns") % 1000000007).alias("check_sum"))
    )


@query(
    "sequence_checks",
    f"""with {views.DUCK_SCHED}, a as (select capture_id, event_id, event_id as event_index, cpu as id2, ts_ns from sched),
b as (select *, max(event_index) over w as pi, last_value(ts_ns) over w as pt from a
  window w as (partition by capture_id order by event_index {_PRE})),
d as (select capture_id, id2, count(*) - 1 as extra from a group by all)
select capture_id, count(*) as event_count, count(*) filter (event_index <> coalesce(pi + 1, 0)) as index_gaps,
  count(*) filter (ts_ns < pt) as time_reversals,
  (select cast(sum(extra) as bigint) from d where d.capture_id = b.capture_id) as duplicate_ids from b group by capture_id""",
)
def sequence_checks(spark, sf_dir):
    arrivals = views.sched_events(spark, sf_dir).select(
        "capture_id", F.col("event_id").alias("event_index"), F.col("cpu").alias("event_id"), "ts_ns"
    )
    return R.sequence_checks(arrivals)


_ENDS = "('acquired', 'timed_out', 'interrupted', 'failed', 'unknown')"
_DUCK_LSTEPS = f"""{views.DUCK_LOCKS},
ex as (select capture_id, tid, lock_id, event_index, event_id, ts_ns, event_type, path_no as path, owner_evidence from locks
    where event_type <> 'futex_wait'
  union all select capture_id, tid, lock_id, max(event_index) + 1, null, null, 'end', null, null from locks
    where event_type <> 'futex_wait' group by capture_id, tid, lock_id),
fl as (select *, count(*) filter (event_type in {_ENDS}) over w as eb, count(*) filter (event_type = 'released') over w as rb
  from ex window w as (partition by capture_id, tid, lock_id order by event_index {_PRE})),
st as (select *, count(*) filter (event_type = 'lock_wait') over (partition by capture_id, tid, lock_id, eb order by event_index {_PRE}) as waits,
  count(*) filter (event_type = 'acquired') over (partition by capture_id, tid, lock_id, rb order by event_index {_PRE}) as acquires,
  last_value(case when event_type = 'lock_wait' then ts_ns end ignore nulls) over w as w_ts,
  last_value(case when event_type = 'lock_wait' then event_id end ignore nulls) over w as w_id,
  last_value(case when event_type = 'lock_wait' then path end ignore nulls) over w as w_path,
  last_value(case when event_type = 'lock_wait' then owner_evidence end ignore nulls) over w as w_owner,
  last_value(case when event_type = 'acquired' then ts_ns end ignore nulls) over w as a_ts,
  last_value(case when event_type = 'acquired' then event_id end ignore nulls) over w as a_id,
  last_value(case when event_type = 'acquired' then path end ignore nulls) over w as a_path
  from fl window w as (partition by capture_id, tid, lock_id order by event_index {_PRE})),
wait_i as (select capture_id, tid, lock_id, w_ts as wait_ns, ts_ns as wait_end_ns, ts_ns - w_ts as duration_ns,
  w_id as wait_event_id, event_id as wait_end_event_id, event_type as outcome, w_owner as owner_evidence, w_path as path
  from st where event_type in {_ENDS} and waits = 1),
hold_i as (select capture_id, tid, lock_id, a_ts as acquired_ns, ts_ns as released_ns, ts_ns - a_ts as duration_ns,
  a_id as acquired_event_id, event_id as released_event_id, a_path as path from st where event_type = 'released' and acquires % 2 = 1),
obs as (select capture_id, tid, lock_id, path, 'wait' as measure, duration_ns, outcome, owner_evidence from wait_i
  union all select capture_id, tid, lock_id, path, 'hold', duration_ns, null, null from hold_i
  union all select capture_id, tid, lock_id, path_no, 'candidate_wait', null, null, null from locks where event_type = 'futex_wait')
"""


def _lock_agg_sql(keys: str) -> str:
    outcomes = ", ".join(
        f"count(*) filter (measure = 'wait' and outcome = '{o}') as {o}_count" for o in L.WAIT_ENDS
    )
    return f"""select {keys}, {outcomes}, count(*) filter (measure = 'candidate_wait') as candidate_wait_count,
  count(*) filter (measure = 'candidate_wake') as candidate_wake_count,
  count(*) filter (measure = 'wait' and owner_evidence <> 'unavailable') as owner_observed_count,
  {dist_sql('wait', 'duration_ns', "measure = 'wait'")}, {dist_sql('hold', 'duration_ns', "measure = 'hold'")}
  from obs group by {keys}"""


def lock_steps(spark, sf_dir):
    return L.lock_steps(views.lock_events(spark, sf_dir))


def lock_observations(spark, sf_dir):
    events = views.lock_events(spark, sf_dir)
    return L.observations(events, L.lock_steps(events))


@query("lock_waits", f"with {_DUCK_LSTEPS} select * from wait_i")
def lock_waits(spark, sf_dir):
    return L.wait_intervals(lock_steps(spark, sf_dir))


@query("lock_holds", f"with {_DUCK_LSTEPS} select * from hold_i")
def lock_holds(spark, sf_dir):
    return L.hold_intervals(lock_steps(spark, sf_dir))


@query(
    "lock_issues",
    f"""with {_DUCK_LSTEPS}, i as (select capture_id, 'wait' as phase, case when event_type in {_ENDS} and waits > 1 then 'duplicate_wait'
    when event_type in {_ENDS} and waits = 0 then 'trace_start_boundary' when event_type = 'end' and waits > 1 then 'duplicate_wait'
    when event_type = 'end' and waits = 1 then 'trace_end_boundary' end as reason from st
  union all select capture_id, 'hold', case when event_type = 'acquired' and acquires % 2 = 1 then 'overlapping_acquire'
    when event_type = 'released' and acquires % 2 = 0 then 'release_without_acquire'
    when event_type = 'end' and acquires % 2 = 1 then 'trace_end_boundary' end from st)
select capture_id, phase, reason, count(*) as issues from i where reason is not null group by all""",
)
def lock_issues(spark, sf_dir):
    return (
        L.pairing_issues(lock_steps(spark, sf_dir))
        .groupBy("capture_id", "phase", "reason")
        .agg(F.count(F.lit(1)).alias("issues"))
    )


@query("lock_by_lock", f"with {_DUCK_LSTEPS} {_lock_agg_sql('capture_id, lock_id')}")
def lock_by_lock(spark, sf_dir):
    return L.aggregate_by(lock_observations(spark, sf_dir), ["capture_id", "lock_id"])


@query("lock_by_thread", f"with {_DUCK_LSTEPS} {_lock_agg_sql('capture_id, tid')}")
def lock_by_thread(spark, sf_dir):
    return L.aggregate_by(lock_observations(spark, sf_dir), ["capture_id", "tid"])


@query("lock_by_path", f"with {_DUCK_LSTEPS} {_lock_agg_sql('capture_id, path')}")
def lock_by_path(spark, sf_dir):
    return L.aggregate_by(lock_observations(spark, sf_dir), ["capture_id", "path"])


@query(
    "lock_rollup",
    f"""with {_DUCK_LSTEPS}, w as (select capture_id, lock_id, count(distinct tid) as waiter_thread_count from wait_i group by all),
p as (select capture_id, lock_id, path, count(*) filter (measure = 'wait') as wait_count,
  count(*) filter (measure = 'hold') as hold_count, cast(coalesce(sum(duration_ns) filter (measure = 'wait'), 0) as bigint) as wait_ns
  from obs where measure in ('wait', 'hold') group by all)
select p.*, waiter_thread_count from p left join w on p.capture_id = w.capture_id and p.lock_id = w.lock_id""",
)
def lock_rollup(spark, sf_dir):
    observed = lock_observations(spark, sf_dir)
    return L.path_occurrences(observed).join(L.waiter_threads(observed), ["capture_id", "lock_id"], "left")


@query(
    "worst_locks",
    f"""with {_DUCK_LSTEPS}, a as (select 'wait' as phase, capture_id, lock_id, tid, duration_ns, wait_event_id as event_id from wait_i
  union all select 'hold', capture_id, lock_id, tid, duration_ns, acquired_event_id from hold_i),
r as (select *, cast(row_number() over (partition by phase, capture_id order by duration_ns desc, lock_id, tid,
  cast(event_id as varchar)) as int) as rank from a) select * from r where rank <= 100""",
)
def worst_locks(spark, sf_dir):
    s = lock_steps(spark, sf_dir)
    common = ["capture_id", "lock_id", "tid", "duration_ns"]
    waits = L.worst_waits(L.wait_intervals(s)).select(
        F.lit("wait").alias("phase"), *common, F.col("wait_event_id").alias("event_id"), "rank"
    )
    holds = L.worst_holds(L.hold_intervals(s)).select(
        F.lit("hold").alias("phase"), *common, F.col("acquired_event_id").alias("event_id"), "rank"
    )
    return waits.unionByName(holds)


@query(
    "futex_candidates",
    f"""with {views.DUCK_LOCKS} select capture_id, tid, lock_id, count(*) as candidate_waits, min(ts_ns) as first_ns, max(ts_ns) as last_ns
    from locks where event_type = 'futex_wait' group by all""",
)
def futex_candidates(spark, sf_dir):
    return (
        views.lock_events(spark, sf_dir)
        .where(L.is_candidate())
        .groupBy("capture_id", "tid", "lock_id")
        .agg(
            F.count(F.lit(1)).alias("candidate_waits"),
            F.min("ts_ns").alias("first_ns"),
            F.max("ts_ns").alias("last_ns"),
        )
    )


_PHASE = "case when event_id % 97 = 0 then 'lost' when event_type in ('lock_wait', 'futex_wait') then 'begin' when event_type = 'released' then 'begin_unknown' else 'end' end"
_RESULT = "case event_id % 5 when 0 then -110 when 1 then -4 when 2 then -35 else 0 end"


@query(
    "contention_merge",
    f"""with {views.DUCK_LOCKS}, e as (select * exclude (event_type), {_PHASE} as kind, {_RESULT} as result from locks),
f as (select *, count(*) filter (kind = 'lost') over (partition by capture_id order by event_index) as epoch from e),
g as (select *, count(*) filter (kind = 'end') over (partition by capture_id, tid, lock_id, epoch order by event_index {_PRE}) as seg
  from f where kind <> 'lost'),
h as (select *, count(*) filter (kind = 'begin') over (partition by capture_id, tid, lock_id, epoch, seg order by event_index {_PRE}) as begins from g),
i as (select *, count(*) filter (kind = 'begin_unknown' and begins > 0) over (partition by capture_id, tid, lock_id, epoch, seg order by event_index {_PRE}) as poisons from h)
select capture_id, tid, lock_id, event_index, case when kind = 'begin' and begins = 0 then 'lock_wait' when kind = 'begin' and poisons = 0 then 'merged'
  when kind = 'begin' then 'poisoned' when kind = 'begin_unknown' then 'unsupported' when result = 0 and poisons = 0 and begins > 0 then 'acquired'
  when result = 0 then 'unknown' when result = -110 then 'timed_out' when result = -4 then 'interrupted' else 'failed' end as action from i""",
)
def contention_merge(spark, sf_dir):
    events = (
        views.lock_events(spark, sf_dir)
        .withColumn("result", F.expr(_RESULT))
        .withColumn("event_type", F.expr(_PHASE))
    )
    return L.merge_contention(R.lost_epochs(events)).select("capture_id", "tid", "lock_id", "event_index", "action")
