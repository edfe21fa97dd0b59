"""Verification queries: results of the other operators with damage dealt by rule, and how often each check breaks.

The damage is one list of SQL expressions for Spark and for DuckDB; the twins count broken rows by their
own windows, joins and groups over the damaged rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import locks as L
from gristmill.operators import quality as Q
from gristmill.operators import runtime_locks as RL
from gristmill.operators import sched as R
from gristmill.operators import verify as V
from gristmill.operators.ordered import cut
from gristmill.plans import views
from gristmill.plans.registry import query
from gristmill.plans.runtime_queries import _DUCK_REPLAY, observed
from gristmill.plans.trace_queries import _DUCK_LSTEPS, _DUCK_STEPS, _lock_agg_sql, dist_sql

LATER = 10**17  # nanoseconds by which a damaged time leaves its window


def damaged(df: DataFrame, damage: dict[str, str]) -> DataFrame:
    """``df`` with columns replaced; every expression sees the columns as they were."""
    return df.select(*[F.expr(damage[c]).alias(c) if c in damage else F.col(c) for c in df.columns])


def _replace(damage: dict[str, str]) -> str:
    return "replace (" + ", ".join(f"{e} as {c}" for c, e in damage.items()) + ")"


def _check_rows(relation: str, broken: dict[str, str]) -> str:
    """Check rows of a relation, from one condition per check."""
    counts = ", ".join(f"count(*) filter (coalesce({b}, false)) as f{i}" for i, b in enumerate(broken.values()))
    names = ", ".join(f"'{n}'" for n in broken)
    values = ", ".join(f"f{i}" for i in range(len(broken)))
    return f"""select capture_id, unnest([{names}]) as "check", checked, unnest([{values}]) as failures
  from (select capture_id, count(*) as checked, {counts} from {relation} group by capture_id)"""


# repeated ids, a gap and a repeated index, times that leave order and window, threads outside the target
_EVENT_DAMAGE = {
    "event_id": "case when event_id % 101 in (3, 4) then -(event_id % 5) - 1 else event_id end",
    "event_index": "case when event_id % 103 = 5 then event_index + 1 else event_index end",
    "ts_ns": f"case when event_id % 107 = 9 then ts_ns - {LATER} else ts_ns end",
    "tid": "case when event_id % 109 = 11 then 1000000 else tid end",
}


def _scope(events: DataFrame) -> DataFrame:
    """Window and threads of the target, from the events before damage; every 13th thread is not the target's."""
    return events.groupBy("capture_id").agg(
        F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.collect_set(F.when(F.col("tid") % 13 != 4, F.col("tid"))).alias("target_tids")
    )


_WINDOWS = "sc as (select capture_id, min(ts_ns) as start_ns, max(ts_ns) as end_ns from {rows} group by capture_id)"


@query(
    "verify_events",
    f"""with {views.DUCK_SCHED}, {_WINDOWS.format(rows='sched')}, d0 as (select capture_id, event_id, event_index, ts_ns, tid, cpu from sched),
d as (select * {_replace(_EVENT_DAMAGE)} from d0),
p as (select d.*, start_ns, end_ns, lag((event_index, ts_ns, cpu, event_id)) over w as prev, lag(event_index) over w as pi
  from d join sc using (capture_id) window w as (partition by d.capture_id order by event_index, event_id)),
n as (select capture_id, event_id, count(*) as c from d group by all)
{_check_rows('p', {
    'event_indexes_contiguous': 'event_index <> coalesce(pi + 1, 0)',
    'events_in_canonical_order': 'pi is not null and (prev[2], prev[3], prev[4]) > (ts_ns, cpu, event_id)',
    'events_inside_window': 'ts_ns < start_ns or ts_ns > end_ns',
    'event_threads_in_scope': 'tid % 13 = 4 or tid = 1000000',
})}
union all select capture_id, 'event_ids_unique', cast(sum(c) as bigint), cast(sum(c - 1) as bigint) from n group by capture_id""",
)
def verify_events(spark, sf_dir):
    events = views.sched_events(spark, sf_dir).select("capture_id", "event_id", "event_index", "ts_ns", "tid", "cpu")
    return V.event_checks(damaged(events, _EVENT_DAMAGE), _scope(events))


_RUN_DAMAGE = {
    "duration_ns": "case when switch_out_event_id % 11 = 0 then duration_ns + 1 else duration_ns end",
    "switch_in_ns": f"case when switch_out_event_id % 13 = 0 then switch_out_ns + 5 when switch_out_event_id % 17 = 0 then switch_in_ns - {LATER} else switch_in_ns end",
}
_LATENCY_DAMAGE = {"switch_in_ns": "case when switch_in_event_id % 5 = 0 then wakeup_ns - 1 else switch_in_ns end"}
_OFF_DAMAGE = {
    "total_ns": "case when switch_in_event_id % 17 = 0 then null when switch_in_event_id % 29 = 0 then 3 else total_ns end",
    "blocked_ns": "case when switch_in_event_id % 7 = 0 then coalesce(blocked_ns, 0) + 1 else blocked_ns end",
    "runnable_ns": "case when switch_in_event_id % 31 = 0 then null else runnable_ns end",
    "unknown_ns": "case when switch_in_event_id % 19 = 0 then 5 else unknown_ns end",
    "wakeup_ns": f"case when switch_in_event_id % 23 = 0 then wakeup_ns + {LATER} else wakeup_ns end",
    "incomplete_reason": "case when wakeup_count % 2 = 1 then null else incomplete_reason end",
    "split_complete": "split_complete or (not complete and wakeup_count = 2)",
    "runnable_suffix_ns": "case when switch_in_event_id % 3 = 0 then runnable_suffix_ns + 1 else runnable_suffix_ns end",
    "blocked_prefix_ns": "case when wakeup_event_id % 3 = 0 then blocked_prefix_ns - 1 else blocked_prefix_ns end",
}
_WAIT_DAMAGE = {
    "duration_ns": "case when wait_end_event_id % 7 = 0 then null else duration_ns end",
    "wait_end_ns": f"case when wait_end_event_id % 11 = 0 then wait_end_ns + {LATER} else wait_end_ns end",
}
_HOLD_DAMAGE = {"released_ns": "case when released_event_id % 5 = 0 then acquired_ns - 2 else released_ns end"}


def _span_rows(kind: str, relation: str, start: str, end: str) -> str:
    return _check_rows(relation, {
        f"{kind}_ends_after_start": f"{end} < {start}",
        f"{kind}_duration_exact": f"duration_ns is distinct from {end} - {start}",
        f"{kind}_inside_window": f"least({start}, {end}) < start_ns or greatest({start}, {end}) > end_ns",
    })


_ENDS = "switch_out_ns is not null and switch_in_ns is not null and total_ns is not null and unknown_ns is not null"
_PARTS = "wakeup_ns is not null and blocked_ns is not null and runnable_ns is not null and coalesce(unknown_ns = 0, false)"
_OFF_BROKEN = {
    "off_cpu_incomplete_without_duration": "not complete and coalesce(total_ns, blocked_ns, runnable_ns, unknown_ns) is not null",
    "off_cpu_incomplete_has_reason": "not complete and incomplete_reason is null",
    "off_cpu_incomplete_not_split": "not complete and split_complete",
    "off_cpu_complete_has_ends": f"complete and not ({_ENDS})",
    "off_cpu_total_exact": f"complete and {_ENDS} and total_ns <> switch_in_ns - switch_out_ns",
    "off_cpu_parts_conserved": f"complete and {_ENDS} and total_ns <> coalesce(blocked_ns, 0) + coalesce(runnable_ns, 0) + unknown_ns",
    "off_cpu_split_has_parts": f"complete and split_complete and not ({_PARTS})",
    "off_cpu_unsplit_without_parts": "complete and not split_complete and coalesce(blocked_ns, runnable_ns) is not null",
    "off_cpu_wakeup_inside": f"complete and split_complete and {_ENDS} and {_PARTS} and (wakeup_ns < switch_out_ns or wakeup_ns > switch_in_ns)",
    "off_cpu_blocked_exact": f"complete and split_complete and {_ENDS} and {_PARTS} and blocked_ns + switch_out_ns <> wakeup_ns",
    "off_cpu_runnable_exact": f"complete and split_complete and {_ENDS} and {_PARTS} and runnable_ns + wakeup_ns <> switch_in_ns",
    "off_cpu_prefix_exact": "blocked_prefix_ns + switch_out_ns <> wakeup_ns",
    "off_cpu_suffix_exact": "runnable_suffix_ns + wakeup_ns <> switch_in_ns",
    "off_cpu_inside_window": "switch_out_ns not between start_ns and end_ns or wakeup_ns not between start_ns and end_ns or switch_in_ns not between start_ns and end_ns",
}


@query(
    "verify_intervals",
    f"""with {_DUCK_STEPS}, {_WINDOWS.format(rows='sched')},
a as (select * from (select * {_replace(_RUN_DAMAGE)} from run_i) join sc using (capture_id)),
b as (select * from (select * {_replace(_LATENCY_DAMAGE)} from lat_i) join sc using (capture_id)),
c as (select * from (select * {_replace(_OFF_DAMAGE)} from off_i) join sc using (capture_id))
{_span_rows('run', 'a', 'switch_in_ns', 'switch_out_ns')} union all {_span_rows('runnable', 'b', 'wakeup_ns', 'switch_in_ns')}
union all {_check_rows('c', _OFF_BROKEN)}""",
)
def verify_intervals(spark, sf_dir):
    events = views.sched_events(spark, sf_dir)
    steps = cut(R.transitions(events))
    scope = cut(_scope(events))
    return V.report([
        V.interval_checks("run", damaged(R.runtime_intervals(steps), _RUN_DAMAGE), scope),
        V.interval_checks("runnable", damaged(R.runnable_latencies(steps), _LATENCY_DAMAGE), scope),
        V.interval_checks("off_cpu", damaged(R.off_cpu_intervals(steps), _OFF_DAMAGE), scope),
    ])


@query(
    "verify_lock_intervals",
    f"""with {_DUCK_LSTEPS}, {_WINDOWS.format(rows='locks')},
a as (select * from (select * {_replace(_WAIT_DAMAGE)} from wait_i) join sc using (capture_id)),
b as (select * from (select * {_replace(_HOLD_DAMAGE)} from hold_i) join sc using (capture_id))
{_span_rows('wait', 'a', 'wait_ns', 'wait_end_ns')} union all {_span_rows('hold', 'b', 'acquired_ns', 'released_ns')}""",
)
def verify_lock_intervals(spark, sf_dir):
    events = views.lock_events(spark, sf_dir)
    steps = cut(L.lock_steps(events))
    scope = cut(_scope(events))
    return V.report([
        V.interval_checks("wait", damaged(L.wait_intervals(steps), _WAIT_DAMAGE), scope),
        V.interval_checks("hold", damaged(L.hold_intervals(steps), _HOLD_DAMAGE), scope),
    ])


_THREAD_DAMAGE = {
    "runtime_p95_ns": "case when tid % 7 = 1 then runtime_minimum_ns - 1 else runtime_p95_ns end",
    "runtime_mean_ns": "case when tid % 5 = 1 then runtime_mean_ns + 1 else runtime_mean_ns end",
    "runtime_total_ns": "case when tid % 11 = 2 then runtime_max_ns * runtime_sample_count + 1 else runtime_total_ns end",
    "runnable_sample_count": "case when tid % 3 = 2 then 0 else runnable_sample_count end",
}


def _dist_broken(p: str) -> dict[str, str]:
    steps = [f"coalesce({p}_{x}, 0)" for x in ("minimum_ns", "p50_ns", "p95_ns", "p99_ns", "max_ns")]
    return {
        f"{p}_quantiles_ordered": f"[{', '.join(steps)}] <> list_sort([{', '.join(steps)}])",
        f"{p}_empty_without_values": f"{p}_sample_count = 0 and ({p}_total_ns <> 0 or {p}_mean_ns <> 0 or greatest({', '.join(steps)}) <> 0 or least({', '.join(steps)}) <> 0)",
        f"{p}_mean_exact": f"{p}_sample_count > 0 and {p}_mean_ns <> {p}_total_ns // nullif({p}_sample_count, 0)",
        f"{p}_total_within_bounds": f"{p}_sample_count > 0 and ({p}_total_ns < {p}_minimum_ns * {p}_sample_count or {p}_total_ns > {p}_max_ns * {p}_sample_count)",
    }


@query(
    "verify_distributions",
    f"""with {_DUCK_STEPS}, m as (select capture_id, tid, duration_ns as rt, null as lt from run_i union all select capture_id, tid, null, duration_ns from lat_i),
th as (select distinct capture_id, tid from st),
t as (select th.capture_id, th.tid, {dist_sql('runtime', 'rt')}, {dist_sql('runnable', 'lt')} from th left join m on th.capture_id = m.capture_id and th.tid = m.tid group by all),
d as (select * {_replace(_THREAD_DAMAGE)} from t)
{_check_rows('d', _dist_broken('runtime') | _dist_broken('runnable'))}""",
)
def verify_distributions(spark, sf_dir):
    threads = R.thread_summary(R.transitions(views.sched_events(spark, sf_dir)))
    return V.distribution_checks(damaged(threads, _THREAD_DAMAGE), ["runtime", "runnable"])


_OFF_THREAD_DAMAGE = {
    "complete_count": "case when tid % 5 = 1 then complete_count + 1 else complete_count end",
    "split_complete_count": "case when tid % 7 = 2 then split_complete_count + 2 else split_complete_count end",
    "blocked_total_ns": "case when tid % 11 = 3 then blocked_total_ns + 1 else blocked_total_ns end",
    "sleep_count": "case when tid % 13 = 4 then sleep_count - 1 else sleep_count end",
    "tid": "case when tid % 17 = 5 then tid - 5 else tid end",
}
_OFF_MEASURES = ["off_cpu_total_ns", "blocked_total_ns", "runnable_total_ns", "unknown_total_ns", "complete_count", "split_complete_count", "incomplete_count"]


def _conserved_sql(name: str, parts: str, totals: str, measures: list[str]) -> str:
    """Check rows that compare sums of ``parts`` with the rows of ``totals``."""
    off = " + ".join(f"case when coalesce(p.{m}, 0) <> coalesce(t.{m}, 0) then 1 else 0 end" for m in measures)
    sums = ", ".join(f"sum({m}) as {m}" for m in measures)
    return f"""select capture_id, '{name}' as "check", cast({len(measures)} as bigint) as checked, cast({off} as bigint) as failures
  from (select capture_id, {sums} from {parts} group by capture_id) p full join {totals} t using (capture_id)"""


@query(
    "verify_off_cpu_threads",
    f"""with {_DUCK_STEPS}, th as (select distinct capture_id, tid from st),
t as (select th.capture_id, th.tid, count(*) filter (complete) as complete_count, count(*) filter (split_complete) as split_complete_count,
  count(*) filter (not complete) as incomplete_count, count(*) filter (complete and category = 'sleep') as sleep_count,
  count(*) filter (complete and category = 'unknown') as unknown_category_count, {dist_sql('off_cpu', 'total_ns')}, {dist_sql('blocked', 'blocked_ns')},
  {dist_sql('runnable', 'runnable_ns')}, {dist_sql('unknown', 'unknown_ns', 'complete and not split_complete')}
  from th left join off_i o on th.capture_id = o.capture_id and th.tid = o.tid group by th.capture_id, th.tid),
d as (select * {_replace(_OFF_THREAD_DAMAGE)} from t), n as (select capture_id, tid, count(*) as c from d group by all),
s as (select capture_id, {', '.join(f'sum({m}) as {m}' for m in _OFF_MEASURES)} from t group by capture_id)
{_check_rows('d', {
    'off_cpu_count_matches_samples': 'complete_count <> off_cpu_sample_count',
    'off_cpu_split_count_matches_blocked': 'split_complete_count <> blocked_sample_count',
    'off_cpu_split_count_matches_runnable': 'split_complete_count <> runnable_sample_count',
    'off_cpu_unknown_count_is_the_rest': 'unknown_sample_count + split_complete_count <> complete_count',
    'off_cpu_thread_time_conserved': 'off_cpu_total_ns - blocked_total_ns - runnable_total_ns - unknown_total_ns <> 0',
    'off_cpu_categories_conserved': 'complete_count - sleep_count <> unknown_category_count',
})}
union all select capture_id, 'off_cpu_threads_unique', cast(sum(c) as bigint), cast(sum(c) - count(*) as bigint) from n group by capture_id
union all {_conserved_sql('off_cpu_totals_conserved', 'd', 's', _OFF_MEASURES)}""",
)
def verify_off_cpu_threads(spark, sf_dir):
    threads = cut(R.off_cpu_summary(R.transitions(views.sched_events(spark, sf_dir))))
    totals = V.sums(threads, _OFF_MEASURES)
    bad = damaged(threads, _OFF_THREAD_DAMAGE)
    return V.report([V.off_cpu_thread_checks(bad), V.conserved("off_cpu_totals_conserved", bad, totals, _OFF_MEASURES)])


_LOCK_MEASURES = ["wait_sample_count", "wait_total_ns", "hold_sample_count", "hold_total_ns", "candidate_wait_count", "candidate_wake_count"]
_LOCK_DAMAGE = {
    "wait_count": "case when lock_id = '0' and capture_id = 2 then wait_count - 1 else wait_count end",
    "hold_count": "case when capture_id = 1 then hold_count + 1 else hold_count end",
    "timed_out_count": "case when lock_id = '1' then timed_out_count + 1 else timed_out_count end",
    "lock_id": "case when lock_id = '2' and capture_id % 2 = 0 then '0' else lock_id end",
}
_BY_THREAD_DAMAGE = {"wait_total_ns": "case when tid = 3 and capture_id <> 1 then wait_total_ns + 7 else wait_total_ns end"}
_BY_PATH_DAMAGE = {
    "hold_sample_count": "case when path = 2 then hold_sample_count + capture_id else hold_sample_count end",
    "candidate_wait_count": "case when path = 1 and capture_id = 3 then 0 else candidate_wait_count end",
}


@query(
    "verify_lock_projections",
    f"""with {_DUCK_LSTEPS}, l as ({_lock_agg_sql('capture_id, lock_id')}), t as ({_lock_agg_sql('capture_id, tid')}), p as ({_lock_agg_sql('capture_id, path')}),
s as (select capture_id, {', '.join(f'sum({m}) as {m}' for m in _LOCK_MEASURES)} from l group by capture_id),
dl as (select * {_replace(_LOCK_DAMAGE)} from (select *, wait_sample_count as wait_count, hold_sample_count as hold_count from l)), dt as (select * {_replace(_BY_THREAD_DAMAGE)} from t), dp as (select * {_replace(_BY_PATH_DAMAGE)} from p),
n as (select capture_id, lock_id, count(*) as c from dl group by all)
{_check_rows('dl', {
    'lock_wait_count_matches_samples': 'wait_count <> wait_sample_count', 'lock_hold_count_matches_samples': 'hold_count <> hold_sample_count',
    'lock_outcomes_conserved': ' + '.join(f'{o}_count' for o in L.WAIT_ENDS) + ' <> wait_count',
})}
union all select capture_id, 'locks_unique', cast(sum(c) as bigint), cast(sum(c) - count(*) as bigint) from n group by capture_id
union all {_conserved_sql('threads_conserve_locks', 'dt', 's', _LOCK_MEASURES)} union all {_conserved_sql('paths_conserve_locks', 'dp', 's', _LOCK_MEASURES)}""",
)
def verify_lock_projections(spark, sf_dir):
    events = views.lock_events(spark, sf_dir)
    seen = cut(L.observations(events, L.lock_steps(events)))
    locks = cut(L.aggregate_by(seen, ["capture_id", "lock_id"]))
    totals = locks.groupBy("capture_id").agg(*[F.sum(m).alias(m) for m in _LOCK_MEASURES])
    threads = damaged(L.aggregate_by(seen, ["capture_id", "tid"]), _BY_THREAD_DAMAGE)
    paths = damaged(L.aggregate_by(seen, ["capture_id", "path"]), _BY_PATH_DAMAGE)
    return V.report([
        V.lock_checks(damaged(locks.select("*", F.col("wait_sample_count").alias("wait_count"), F.col("hold_sample_count").alias("hold_count")), _LOCK_DAMAGE)),
        V.conserved("threads_conserve_locks", threads, totals, _LOCK_MEASURES),
        V.conserved("paths_conserve_locks", paths, totals, _LOCK_MEASURES),
    ])


_RT_MEASURES = ["observation_count", "observed_or_estimated_wait_ns", "exact_hold_sample_count", "exact_hold_total_ns"]
_RT_DAMAGE = {
    "observation_count": "case when context = '3' and capture_id < 2 then observation_count - 1 else observation_count end",
    "exact_hold_total_ns": "case when context = '5' and capture_id <> 2 then exact_hold_total_ns + 1 else exact_hold_total_ns end",
}


@query(
    "verify_runtime_projections",
    f"""with {_DUCK_REPLAY}, o as (select capture_id, context, cast(count(*) filter (measure <> 'exact_hold' and measure <> 'sampled') + coalesce(sum(cnt), 0) as bigint) as observation_count,
  sum(wait_ns) as observed_or_estimated_wait_ns, count(*) filter (measure = 'exact_hold') as exact_hold_sample_count,
  coalesce(sum(duration_ns) filter (measure = 'exact_hold'), 0) as exact_hold_total_ns from fo group by capture_id, context),
s as (select capture_id, {', '.join(f'sum({m}) as {m}' for m in _RT_MEASURES)} from o group by capture_id),
d as (select * {_replace(_RT_DAMAGE)} from o)
{_conserved_sql('contexts_conserve_totals', 'd', 's', _RT_MEASURES)}""",
)
def verify_runtime_projections(spark, sf_dir):
    seen = observed(spark, sf_dir)
    contexts = damaged(RL.metrics_by(seen, ["context"]), _RT_DAMAGE)
    return V.conserved("contexts_conserve_totals", contexts, RL.totals(seen), _RT_MEASURES)


# lost, doubled and changed intervals of a stored analysis
_STORED = f"""select unnest(case when switch_out_event_id % 31 = 0 then [1, 2] when switch_out_event_id % 29 = 0 then [] else [1] end) as copy, * {_replace(_RUN_DAMAGE)}"""
_RUN_COLUMNS = ["capture_id", "tid", "switch_in_ns", "switch_out_ns", "duration_ns", "switch_in_event_id", "switch_out_event_id"]


@query(
    "verify_replay",
    f"""with {_DUCK_STEPS}, d as (select * exclude (copy) from ({_STORED} from run_i)),
b as (select {', '.join(_RUN_COLUMNS)}, 1 as s from d union all select {', '.join(_RUN_COLUMNS)}, -1 from run_i)
select {', '.join(_RUN_COLUMNS)}, cast(sum(s) as bigint) as copies from b group by all having sum(s) <> 0""",
)
def verify_replay(spark, sf_dir):
    """Stored runs against those replayed from the events: what is lost, doubled or changed."""
    runs = cut(R.runtime_intervals(R.transitions(views.sched_events(spark, sf_dir))))
    copies = F.expr("explode(case when switch_out_event_id % 31 = 0 then array(1, 2) when switch_out_event_id % 29 = 0 then array() else array(1) end)")
    stored = damaged(runs.select("*", copies.alias("copy")), _RUN_DAMAGE)
    return V.multiset_difference(stored, runs, _RUN_COLUMNS)


_LEDGER_DAMAGE = {
    "total_count": "case when capture_id = 2 and disposition = 'unpaired' then total_count + 1 else total_count end",
    "ids_sha256": "case when capture_id = 3 then concat(ids_sha256, 'x') else ids_sha256 end",
    "truncated": "case when capture_id = 4 then not truncated else truncated end",
    "ids": "case when capture_id = 1 then concat(array('no such id', ids[0]), ids) else ids end",
}


@query(
    "verify_accounting",
    f"""with {_DUCK_STEPS}, used as (select capture_id, switch_in_event_id as event_id from run_i
  union select capture_id, switch_out_event_id from run_i union select capture_id, wakeup_event_id from lat_i
  union select capture_id, switch_in_event_id from lat_i union select capture_id, switch_out_event_id from off_i where complete
  union select capture_id, switch_in_event_id from off_i where complete union select capture_id, wakeup_event_id from off_i where split_complete),
g as (select s.capture_id, case when event_type = 'waking' then 'ignored' when u.event_id is not null or event_type = 'migrate' then 'consumed' else 'unpaired' end as disposition,
  count(*) as n, least(count(*), 20) as kept from sched s left join used u on s.capture_id = u.capture_id and s.event_id = u.event_id group by all),
c as (select capture_id, count(*) as ledgers, cast(sum(case when capture_id = 1 then kept + 2 else kept end) as bigint) as samples,
  count(*) filter (disposition = 'unpaired') as unpaired, cast(sum(kept) as bigint) as kept, count(*) filter (disposition = 'unpaired' and capture_id = 2) as wrong from g group by all)
select capture_id, unnest(['ledgers_cover_events', 'ledger_sample_without_repeats', 'ledger_truncation_flag_exact', 'ledger_samples_disjoint', 'ledger_samples_known',
    'ledger_counts_recomputed', 'ledger_digests_recomputed']) as "check",
  unnest([1, ledgers, ledgers, samples, samples, ledgers, ledgers]) as checked,
  unnest([wrong, case when capture_id = 1 then ledgers else 0 end, case when capture_id = 4 then ledgers when capture_id = 1 then short when capture_id = 2 then short2 else 0 end,
    case when capture_id = 1 then ledgers + ledgers - 1 else 0 end,
    case when capture_id = 1 then ledgers else 0 end, 2 * wrong, case when capture_id = 3 then 2 * ledgers else 0 end]) as failures
from c join (select capture_id, count(*) filter (n > 20 and n <= 22) as short, count(*) filter (disposition = 'unpaired' and n <= 20) as short2 from g group by all) using (capture_id)""",
)
def verify_accounting(spark, sf_dir):
    events = views.sched_events(spark, sf_dir)
    marked = cut(R.dispositions(events, R.transitions(events)).select("capture_id", "event_index", "event_id", "disposition"))
    ledgers = cut(Q.ledger(marked, keep=20))
    return V.accounting_checks(marked, damaged(ledgers, _LEDGER_DAMAGE), ledgers)


_QUALITY = """select user_id as capture_id, count(*) as input, count(*) filter (where event_type in ('click', 'view')) + count(*) filter (where event_type = 'signup') as emitted,
  count(*) filter (where event_type = 'signup' and event_id % 2 = 0) as expanded, count(*) filter (where event_type = 'purchase' and event_id % 3 = 0) as merged,
  count(*) filter (where event_type = 'error' and event_id % 4 = 0) as lost, count(*) filter (where event_type = 'view' and event_id % 5 = 0) as unpaired,
  count(*) filter (where event_type = 'error') as malformed, count(*) filter (where event_type = 'purchase' and event_id % 3 = 1) as duplicate,
  count(*) filter (where event_type = 'purchase' and event_id % 3 = 2) as out_of_order, count(*) filter (where event_type = 'signup' and event_id % 2 = 0) as unsupported,
  cast(0 as bigint) as truncated, case when user_id % 7 = 1 then cast(1 as bigint) else cast(0 as bigint) end as foreign_rows,
  case when user_id % 5 = 2 then 'verified' else 'partial' end as quality_status from {events} group by user_id"""
_ANALYSIS_DAMAGE = {
    "emitted": "case when capture_id % 11 = 3 then emitted - 1 else emitted end",
    "unpaired": "case when capture_id % 13 = 4 then unpaired - 1 when capture_id % 13 = 5 then emitted + 1 else unpaired end",
    "quality_status": "case when capture_id % 3 = 0 then 'verified' else quality_status end",
}
_DROPPED_SQL = "malformed + duplicate + out_of_order + unsupported + truncated + foreign_rows"
_DEGRADED_SQL = f"(input = 0 or emitted = 0 or lost > 0 or unpaired > 0 or {_DROPPED_SQL} > 0)"


@query(
    "verify_quality",
    f"""with q as ({_QUALITY.format(events='events')}), a as (select * {_replace(_ANALYSIS_DAMAGE)} from q),
m as (select q.*, a.emitted as a_emitted, a.unpaired as a_unpaired, a.quality_status as a_status from q join a using (capture_id))
{_check_rows('q', {
    'inputs_conserved': f'input - ({_DROPPED_SQL}) - merged <> emitted - expanded', 'unpaired_within_emitted': 'unpaired > emitted',
    'status_follows_counters': f"{_DEGRADED_SQL} <> (quality_status = 'partial')",
})} union all {_check_rows('m', {
    'analysis_keeps_counters': 'a_emitted <> emitted', 'analysis_keeps_unpaired': 'a_unpaired < unpaired',
    'analysis_unpaired_within_emitted': 'a_unpaired > a_emitted', 'analysis_status_not_better': f"{_DEGRADED_SQL} and a_status <> 'partial'",
})}""",
)
def verify_quality(spark, sf_dir):
    rows = spark.sql(_QUALITY, events=views.table(spark, sf_dir, "events"))
    later = damaged(rows, _ANALYSIS_DAMAGE)
    return V.quality_checks(rows.withColumnRenamed("foreign_rows", "foreign"), later.withColumnRenamed("foreign_rows", "foreign"))


# runtime-lock evidence: events, tables and counters that disagree by rule
_RT_EVENT_DAMAGE = {
    "event_id": "case when event_id % 101 in (3, 4) then -(event_id % 5) - 1 else event_id end",
    "event_index": "case when event_id % 103 = 5 then event_index - 1 else event_index end",
    "ts_ns": f"case when event_id % 107 = 9 then ts_ns + {LATER} else ts_ns end",
    "semantics": "case when event_id % 97 = 2 then 'cumulative' else semantics end",
    "lock_kind": "case when event_id % 89 = 1 and lock_id = '1' then 'rwlock' else lock_kind end",
}
_RT_QUALITY = """select capture_id, count(*) + capture_id % 2 as input_events, count(*) as emitted_events, cast(0 as bigint) as filtered, cast(0 as bigint) as malformed,
  cast(0 as bigint) as duplicate, cast(0 as bigint) as out_of_order, cast(0 as bigint) as unsupported, cast(0 as bigint) as truncated, cast(capture_id % 3 as bigint) as lost,
  cast(6 as bigint) as input_stacks, cast(6 - capture_id % 2 as bigint) as emitted_stacks, cast(0 as bigint) as malformed_stacks, cast(0 as bigint) as duplicate_stacks,
  cast(0 as bigint) as truncated_stacks, count(owner_context) + capture_id % 4 as owner_observed_events, case when capture_id = 1 then 'partial' else 'complete' end as quality_status,
  count(*) filter (where semantics = 'exact') as exact_events, count(*) filter (where semantics = 'thresholded') as thresholded_events,
  count(*) filter (where semantics = 'sampled') as sampled_events, cast(0 as bigint) as cumulative_events from {rt} group by capture_id"""


@query(
    "verify_runtime_evidence",
    f"""with {views.DUCK_RUNTIME}, d as (select * {_replace(_RT_EVENT_DAMAGE)} from rt), q as ({_RT_QUALITY.format(rt='rt')}),
so as (select capture_id, {views.RUNTIME_SEMANTICS} as src, capture_id % 2 = 0 as owner_seen, capture_id < 2 as hold_seen from (select distinct capture_id from rt)),
sk as (select distinct capture_id, stack_id, cast(substr(stack_id, 2) as int) as depth from rt where stack_id <> 's3'
  union all select distinct capture_id, 's1', 1 from rt where capture_id = 2),
cx as (select distinct capture_id, context, case cast(context as int) % 3 when 0 then 'os_thread' when 1 then 'go_goroutine' else 'process_aggregate' end as kind,
  case when cast(context as int) % 2 = 0 then cast(context as bigint) end as tid from rt where context <> '7' union all select distinct capture_id, 'idle', 'os_thread', 1 from rt),
p as (select d.*, src, owner_seen, hold_seen, lag(event_index) over w as pi, lag(ts_ns) over w as pt from d join so using (capture_id)
  window w as (partition by d.capture_id order by event_index, event_id)),
na as (select capture_id, context as x from d union all select capture_id, owner_context from d where owner_context is not null union all select capture_id, parked_context from d where parked_context is not null),
k as (select capture_id, lock_id, count(distinct lock_kind) > 1 as mixed from d where lock_id is not null group by all),
n1 as (select capture_id, event_id, count(*) as c from d group by all), n2 as (select capture_id, stack_id, count(*) as c from sk group by all), n3 as (select capture_id, context, count(*) as c from cx group by all),
e as (select capture_id, count(*) as emitted_events, count(owner_context) as owner_observed_events, count(*) filter (semantics = 'exact') as exact_events,
  count(*) filter (semantics = 'thresholded') as thresholded_events, count(*) filter (semantics = 'sampled') as sampled_events, count(*) filter (semantics = 'cumulative') as cumulative_events from d group by all),
es as (select capture_id, count(*) as emitted_stacks from sk group by all)
{_check_rows('p', {
    'event_indexes_contiguous': 'event_index <> coalesce(pi + 1, 0)', 'events_in_time_order': 'ts_ns < pt', 'semantics_not_mixed': 'semantics <> src',
    'owners_visible_to_source': 'owner_context is not null and not owner_seen', 'holds_visible_to_source': "event_kind = 'release' and hold_duration_ns is not null and not hold_seen",
})}
union all select capture_id, 'event_ids_unique', cast(sum(c) as bigint), cast(sum(c) - count(*) as bigint) from n1 group by capture_id
union all select capture_id, 'stack_ids_unique', cast(sum(c) as bigint), cast(sum(c) - count(*) as bigint) from n2 group by capture_id
union all select capture_id, 'context_ids_unique', cast(sum(c) as bigint), cast(sum(c) - count(*) as bigint) from n3 group by capture_id
union all {_check_rows("(select * from d where stack_id is not null)", {'stacks_known': "stack_id = 's3'"})}
union all {_check_rows('na', {'contexts_known': "x not in (select context from cx where cx.capture_id = na.capture_id)"})}
union all {_check_rows('cx', {'contexts_all_used': "context not in (select x from na where na.capture_id = cx.capture_id)"})}
union all {_check_rows('sk', {'stack_depth_within_limit': 'depth > 4'})}
union all {_check_rows('cx', {
    'os_threads_have_a_tid': "kind = 'os_thread' and tid is null", 'aggregates_have_no_tid': "kind = 'process_aggregate' and tid is not null",
    'virtual_threads_have_no_tid': "kind = 'go_goroutine' and tid is not null",
})}
union all {_check_rows('k', {'lock_kinds_do_not_change': 'mixed'})}
union all {_check_rows('q', {
    'input_events_conserved': 'input_events <> emitted_events', 'input_stacks_conserved': 'input_stacks <> emitted_stacks',
    'status_follows_counters': "(quality_status = 'partial') <> (lost > 0)", 'gates_disjoint': 'capture_id = 3',
})}
union all {_conserved_sql('emitted_events_counted', 'e', 'q', ['emitted_events'])}
union all {_conserved_sql('owner_observations_conserved', 'e', 'q', ['owner_observed_events'])}
union all {_conserved_sql('semantics_conserved', 'e', 'q', ['exact_events', 'thresholded_events', 'sampled_events', 'cumulative_events'])}
union all {_conserved_sql('emitted_stacks_counted', 'es', 'q', ['emitted_stacks'])}""",
)
def verify_runtime_evidence(spark, sf_dir):
    events = cut(views.runtime_lock_events(spark, sf_dir))
    captures = events.select("capture_id").distinct()
    stacks = events.where("stack_id <> 's3'").select("capture_id", "stack_id").distinct()
    stacks = stacks.unionByName(captures.where("capture_id = 2").withColumn("stack_id", F.lit("s1")))
    stacks = stacks.withColumn("depth", F.expr("cast(substr(stack_id, 2) as int)"))
    number = F.col("context").cast("int")
    contexts = events.where("context <> '7'").select("capture_id", "context").distinct().withColumn(
        "kind", F.when(number % 3 == 0, "os_thread").when(number % 3 == 1, "go_goroutine").otherwise("process_aggregate")
    ).withColumn("tid", F.when(number % 2 == 0, number.cast("long")))
    idle = captures.select("capture_id", F.lit("idle").alias("context"), F.lit("os_thread").alias("kind"), F.lit(1).cast("long").alias("tid"))
    gate = F.array(F.lit("rate"))
    quality = spark.sql(_RT_QUALITY, rt=events).withColumn("allowed_conclusions", gate)
    quality = quality.withColumn("forbidden_conclusions", F.when(F.col("capture_id") == 3, gate).otherwise(F.array(F.lit("cause"))))
    source = captures.select(
        "capture_id", F.expr(views.RUNTIME_SEMANTICS).alias("semantics"), (F.col("capture_id") % 2 == 0).alias("owner_observed"),
        (F.col("capture_id") < 2).alias("hold_observed"), F.lit(4).alias("max_stack_depth"),
    )
    return V.runtime_evidence_checks(damaged(events, _RT_EVENT_DAMAGE), stacks, contexts.unionByName(idle), quality, source)
