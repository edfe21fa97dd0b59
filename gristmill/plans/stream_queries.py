"""Streams replayed from the events table in three batches whose rows come out of order, some of them too late."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.operators import compare as P
from gristmill.operators.ordered import cut_texts, shared_dir
from gristmill.plans import views
from gristmill.plans.compare_queries import _diff_sql, exported_hotspots
from gristmill.plans.registry import query
from gristmill.plans.source_queries import transcript_lines_judged
from gristmill.plans.trace_queries import _DUCK_LSTEPS, _DUCK_STEPS, _OFF
from gristmill.store import ResultStore
from gristmill.streaming import carried as C
from gristmill.streaming import observed as O

HOUR = 3_600_000_000_000
DELAY = 20 * HOUR
_START = 1_704_067_200_000_000_000  # the first day of the table
# a row comes up to 49 hours after its time; batches end after 10 and 20 days
_ARRIVES = f"(ts_ns + (event_id % 50) * {HOUR} - {_START})"
_BATCH = f"case when {_ARRIVES} < {240 * HOUR} then 0 when {_ARRIVES} < {480 * HOUR} then 1 else 2 end"


def _in_time(rows: str) -> str:
    """The rows that do not come behind the watermark of the batch before theirs."""
    return f"""arr as (select *, {_BATCH} as b from {rows}), w0 as (select max(ts_ns) - {DELAY} as w from arr where b = 0),
w1 as (select greatest((select w from w0), max(ts_ns) - {DELAY}) as w from arr where b < 2 and (b = 0 or ts_ns > (select w from w0))),
kept as (select * exclude (b) from arr where b = 0 or (b = 1 and ts_ns > (select w from w0)) or (b = 2 and ts_ns > (select w from w1)))"""


def _over_kept(steps: str, view: str, rows: str) -> str:
    """The twin's steps over the rows that came in time."""
    return f"{view}, {_in_time(rows)}" + steps.removeprefix(view).replace(f"from {rows}", "from kept")


def streamed(spark, events, kind, *wanted):
    """Run the three batches and the end of the stream in a folder of their own; only the results in ``wanted`` are written."""
    folder = f"{shared_dir(spark)}/gristmill-streams/{uuid.uuid4().hex}"
    rows = cut_texts(events.withColumn("__b", F.expr(_BATCH)))  # numbered once, not for each batch
    stream = C.CarriedPairing(spark, folder, kind, events.schema, DELAY, silence_ns=1 << 61, wanted=wanted)
    for batch in range(3):
        stream.step(rows.where(F.col("__b") == batch), batch)
    stream.finish(3)
    return stream


@query("streamed_off_cpu", f"with {_over_kept(_DUCK_STEPS, views.DUCK_SCHED, 'sched')} select {_OFF} from off_i")
def streamed_off_cpu(spark, sf_dir):
    done = streamed(spark, views.sched_events(spark, sf_dir), C.THREADS, "off_cpu")
    return done.result("off_cpu").drop("waker_tid", "batch")


@query("streamed_waits", f"with {_over_kept(_DUCK_LSTEPS, views.DUCK_LOCKS, 'locks')} select * from wait_i")
def streamed_waits(spark, sf_dir):
    return streamed(spark, views.lock_events(spark, sf_dir), C.LOCKS, "waits").result("waits").drop("batch")


@query(
    "streamed_late",
    f"""with {views.DUCK_SCHED}, {_in_time('sched')} select s.capture_id, s.event_type, count(*) as late_rows from sched s anti join kept k on s.event_id = k.event_id group by all""",
)
def streamed_late(spark, sf_dir):
    done = streamed(spark, views.sched_events(spark, sf_dir), C.THREADS)
    return done.result("late").groupBy("capture_id", "event_type").agg(F.count(F.lit(1)).alias("late_rows"))


@query(
    "observed_dispositions",
    """with e as (select event_type, user_id % 10 % 2 = 0 as target, row_number() over (partition by user_id % 5 order by ts, event_id) - 1 as i from events),
d as (select case when event_type = 'view' then 'malformed' when event_type = 'signup' then 'lost'
  when i % 37 = 36 then 'out_of_order' when event_type = 'error' then 'unsupported' when not target then 'foreign' else 'accepted' end as counter from e)
select counter, count(*) as lines from d group by all union all select 'rows', count(*) from d""",
)
def observed_dispositions(spark, sf_dir):
    """What becomes of transcript lines, counted while they are written and not by a job of its own."""
    rows, seen = O.watched(transcript_lines_judged(spark, sf_dir), O.counters_of("disposition", O.TRACE_DISPOSITIONS))
    rows.select("capture_id", "disposition").write.parquet(f"{shared_dir(spark)}/gristmill-streams/judged-{uuid.uuid4().hex}")
    return spark.createDataFrame([(k, int(v)) for k, v in seen.get.items() if v], "counter string, lines long")


@query("stored_profile_diff", _diff_sql(0.05))
def stored_profile_diff(spark, sf_dir):
    """``profile_diff`` of two captures of a store, one of them replaced by a later writing."""
    name = uuid.uuid4().hex
    store = ResultStore(spark, f"{shared_dir(spark)}/gristmill-results/{name}", buckets=16, prefix=f"r{name}")
    spots = exported_hotspots(spark, sf_dir)
    wrong = F.when(F.col("capture_id") == "candidate", F.lit(0.0)).otherwise(F.col("self_percent"))
    store.write("hotspots", spots.withColumn("self_percent", wrong), ["symbol", "dso"])
    store.write("hotspots", spots.where("capture_id = 'candidate'"), ["symbol", "dso"])
    return P.profile_diff(store.read("hotspots", "baseline"), store.read("hotspots", "candidate"), min_delta=0.05)
