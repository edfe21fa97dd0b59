"""Flight-recorder documents made from the events table, each damaged in one way or none, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.plans import views
from gristmill.plans.registry import query
from gristmill.sources import jfr_documents as J

# Every user is a document: the runtime first, then an element per event in order of its id, a data loss last.
# Element m = n // 2 + 1 is the damaged one.
_FILES = """select user_id, count(*) as n, count(*) div 2 + 1 as m, cast(user_id % 15 as int) as damage from {events} group by user_id"""
_BAD = {
    1: ("TRUNCATED", "n + 1"), 2: ("EMPTY_ELEMENT", "n + 2"), 3: ("BELOW_THRESHOLD", "m"), 4: ("OTHER_PROCESS", "0"), 5: ("SECOND_RUNTIME", "n + 2"), 6: ("INVALID_EVENT", "m"),
    7: ("UNKNOWN_FIELD", "m"), 8: ("INVALID_THREAD", "m"), 9: ("INVALID_TIME", "m"), 10: ("INVALID_THREAD", "m"), 11: ("TRAILING_FIELDS", "n + 1"), 12: ("NOT_AN_OBJECT", "n + 2"),
    13: ("OTHER_RUNTIME", "0"), 14: ("NOT_A_RECORDING", "0"),
}
_CASE = "case damage " + " ".join(f"when {d} then {{}}".format(x) for d, x in ((d, f"'{r}'") for d, (r, _) in _BAD.items())) + " end"
_AT = "case damage " + " ".join(f"when {d} then {at}" for d, (_, at) in _BAD.items()) + " end"


def documents(spark, sf_dir):
    """(capture_id, document): texts hold commas, brackets and quotes inside strings, and line breaks between fields."""
    events = views.table(spark, sf_dir, "events")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    number = lambda c: c.cast("string")
    # a document stands in one row here, so the rows of a user meet once, before their texts are made
    own = Window.partitionBy("user_id")
    rows = events.where("user_id is not null").select("user_id", "event_id", "ts", F.row_number().over(own.orderBy("event_id")).cast("long").alias("place"), F.count(F.lit(1)).over(own).alias("n"))
    rows = rows.withColumn("m", F.expr("n div 2 + 1")).withColumn("damage", (F.col("user_id") % 15).cast("int"))
    d, e = F.col("damage"), F.col("event_id")
    hit = F.col("place") == F.col("m")
    virtual = e % 3 == 0
    thread = text(
        '{"osName":"t, {[\\\\","osThreadId":', F.when(hit & (d == 10), "0").when(virtual, "0").otherwise(number(e % 7 + 1)), ',"javaName":"a \\"b\\", }","javaThreadId":', number(e % 9 + 1),
        ',"group":null', F.when(hit & (d == 8), "").otherwise(text(',"virtual":', F.when(virtual & ~(hit & (d == 10)), "true").otherwise("false"))), "}",
    )
    kind = F.when(e % 3 == 0, "jdk.JavaMonitorEnter").when(e % 3 == 1, "jdk.JavaMonitorWait").otherwise("jdk.ThreadPark")
    own = F.when(e % 3 == 0, ',"monitorClass":null,"previousOwner":null').when(e % 3 == 1, ',"monitorClass":null,"notifier":null,"timedOut":true,"timeout":null').otherwise(',"parkedClass":null,"timeout":null,"until":null')
    frame = '{"method":{"type":{"classLoader":null,"name":"a/B","package":null,"modifiers":1,"hidden":false},"name":"run","descriptor":"(II)[V","modifiers":1,"hidden":false},"lineNumber":3,"bytecodeIndex":1,"type":"JIT, compiled"}'
    event = text(
        '{"type":"', kind, '","values":{\n"startTime":"', F.when(hit & (d == 9), "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), '", "duration":"PT0.',
        F.when(hit & (d == 3), "000009").otherwise(F.lpad(number(e % 1000 + 10), 6, "0")), 'S","eventThread":', thread, ',"stackTrace":{"truncated":', F.when(e % 11 == 0, "true").otherwise("false"),
        ',"frames":[', F.when(e % 5 == 0, "").otherwise(frame), ']},"address":', number(e % 4), own, F.when(hit & (d == 6), ',"timedOut ":1').when(hit & (d == 7), ',"monitorClas":1').otherwise(""), "}}",
    )
    event = F.when(hit & (d == 6), F.replace(event, F.lit(',"timedOut ":1'), F.lit(',"total":1'))).otherwise(event)
    joined = rows.groupBy("user_id", "n", "damage").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", event.alias("x")))), lambda r: r["x"]), " , ").alias("body")
    )
    runtime = text(
        '{"type":"jdk.JVMInformation","values":{"startTime":"s","jvmName":"n","jvmVersion":"VM (1) for linux JRE (', F.when(d == 13, "17.0.1").otherwise("21.0.5+11"), '), x","jvmStartTime":"s","pid":',
        F.when(d == 4, "8").otherwise("7"), "}}",
    )
    loss = text('{"type":"jdk.DataLoss","values":{"startTime":"s","amount":', number(F.col("n")), ',"total":', number(F.col("n") + 1), "}}")
    tail = F.when(d == 2, ",").when(d == 5, text(",", runtime)).when(d == 12, ",5").otherwise("")
    end = F.when(d == 1, "").when(d == 11, '],"more":[1,2]}}').otherwise("] }\n}")
    head = F.when(d == 14, '{"recordings":{"events":[').otherwise('{ "recording" : {"events":[')
    return joined.select(F.col("user_id").alias("capture_id"), text(head, runtime, ",\n", F.col("body"), ",", loss, tail, end).alias("document"))


def read(spark, sf_dir):
    made = documents(spark, sf_dir)
    targets = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("capture_id")).distinct().select("capture_id", F.lit(7).cast("long").alias("target_pid"), F.lit(21).alias("jdk_major"), F.lit(10_000).cast("long").alias("threshold_ns"))
    return J.read_documents(J.pieces_of(made), targets)


@query(
    "jfr_documents",
    f"""with f as ({_FILES.format(events='events').replace(' div ', ' // ')}),
t as (select user_id, count(*) filter (event_id % 11 = 0) as cut, count(*) filter (event_id % 5 = 0) as bare from events group by user_id)
select user_id as capture_id, damage = 0 as accepted, {_CASE} as reason, cast({_AT} as bigint) as source_index, n + 2 + case when damage in (2, 5, 12) then 1 else 0 end as events,
  case when damage <> 13 then '21.0.5+11' else '17.0.1' end as runtime_version, cut as truncated_stacks, bare as empty_stacks from f join t using (user_id) where damage <> 14
union all select user_id, false, 'NOT_A_RECORDING', 0, n + 2, '21.0.5+11', null, null from f where damage = 14""",
)
def jfr_documents(spark, sf_dir):
    captures = read(spark, sf_dir).captures
    # the first element of a document that is none is not looked into
    known = F.col("reason").isNull() | (F.col("reason") != "NOT_A_RECORDING")
    return captures.select(
        "capture_id", "accepted", "reason", "source_index", "events", F.when(known, F.col("runtime_version")).otherwise("21.0.5+11").alias("runtime_version"),
        F.when(known, F.col("truncated_stacks")).alias("truncated_stacks"), F.when(known, F.col("empty_stacks")).alias("empty_stacks"),
    )


@query(
    "jfr_document_waits",
    f"""with f as ({_FILES.format(events='events').replace(' div ', ' // ')}), e as (select e.*, epoch_us(ts) * 1000 as began, (event_id % 1000 + 10) * 1000 as lasted from events e join f using (user_id) where damage = 0)
select user_id as capture_id, event_id % 3 as kind, case event_id % 3 when 0 then 'mutex' when 1 then 'condition' else 'park' end as lock_kind, case event_id % 3 when 0 then 'acquired' when 1 then 'timed_out' else 'unknown' end as outcome,
  count(*) as waits, sum(lasted)::bigint as waited_ns, sum((began + lasted - first) % 1000003)::bigint as check_sum, count(*) filter (event_id % 4 <> 0) as locks,
  count(*) filter (event_id % 5 <> 0) as stacks from e join (select user_id, min(began) as first from e group by user_id) using (user_id) group by all""",
)
def jfr_document_waits(spark, sf_dir):
    rows = J.document_waits(read(spark, sf_dir))
    kind = F.col("lock_kind")
    number = F.when(kind == "mutex", 0).when(kind == "condition", 1).otherwise(2).cast("long")
    return rows.groupBy("capture_id", number.alias("kind"), "lock_kind", "outcome").agg(
        F.count(F.lit(1)).alias("waits"), F.sum("duration_ns").alias("waited_ns"), F.sum(F.col("ts_ns") % 1000003).alias("check_sum"),
        F.count("source_lock_id").alias("locks"), F.count("frames").alias("stacks"),
    )
