"""Profiler text written from the orders, with damaged records, and read back.

Every order is a record; ``k`` is its key and decides the form of its header, its frames and its damage.  The
twins work out samples, frames and counters from ``k``, never from the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators.ordered import cut_texts, dense_index
from gristmill.plans import views
from gristmill.plans.registry import query
from gristmill.sources import lines as LN
from gristmill.sources import perf_script as P

# stray text before the record, no frames at all, a line without an address, two kinds of notes, a tail in the header
_STRAY, _EMPTY, _BAD, _NOTE, _ADDRESS, _TAIL = "k % 19 = 7", "k % 17 = 6", "k % 11 = 5", "k % 7 = 3", "k % 7 = 4", "k % 6 = 1"


def _frame_text(j: str) -> str:
    """Frame ``j`` of a record, the leaf being 0; every other one has a source place of its own."""
    return f"""concat(lower(hex(k * 16 + {j})), ' ', case when (k + {j}) % 13 = 12 then '[unknown]' else concat('f', (k + {j}) % 13, '(int)+0x4') end,
      ' (', case when {j} > 0 and k % 5 = 2 then '[kernel.kallsyms]' when k % 4 = 3 then '/opt/My App (v2)/run' else concat('/lib/o', k % 3, '.so') end, ')',
      case when (k + {j}) % 2 = 0 then concat(' /src/a.c:', {j} + 1) else '' end)"""


_HEADER = f"""concat(case when k % 10 = 0 then 'io worker' else concat('t', k % 4) end, ' ', k % 50 + 1, case k % 3 when 0 then concat('/', k % 50 + 2) when 1 then '' else concat('/', k % 50 + 3) end,
  case when k % 3 < 2 then concat(' [', lpad(k % 8, 3, '0'), ']') else '' end, case k % 4 when 0 then ' U' when 1 then ' k' else '' end, ' ', k, '.25: ',
  case when k % 5 = 0 then '' else concat(k % 100 + 1, ' ') end, case when k % 2 = 0 then 'cycles:u' else 'task-clock' end, ':',
  case when {_TAIL} and not ({_EMPTY}) then concat(' ', {_frame_text('0')}) else '' end)"""


def perf_lines(spark, sf_dir):
    """(capture_id, line_no, line)."""
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("cast(o_orderkey % 5 as int)").alias("capture_id"))
    frame = lambda j: F.expr(f"case when not ({_EMPTY}) and {j} <= k % 3 then concat('\\t', {_frame_text(str(j))}) end")
    note = F.expr(f"case when {_NOTE} and not ({_EMPTY}) then '  /src/b.c:9 (inlined)' when {_ADDRESS} and not ({_EMPTY}) then '  [JIT] tid 90[c8]' end")
    parts = [
        F.expr(f"case when {_STRAY} then 'what is this' end"), F.expr(f"case when {_STRAY} then '\\t12 lost (/x)' end"), F.expr(_HEADER),
        frame(0), note, F.expr(f"case when {_BAD} and not ({_EMPTY}) then '\\tno address here' end"), frame(1), frame(2), F.lit(""),
    ]
    parts = F.array_compact(F.array(*parts))
    lines = dense_index(rows, ["capture_id"], ["k"], F.floor(F.col("k") / F.lit(8192)), "i").select("capture_id", "i", F.posexplode(parts).alias("at", "line"))
    numbered = dense_index(lines, ["capture_id"], ["i", "at"], F.floor(F.col("i") / F.lit(8192)), "n")
    return numbered.select("capture_id", (F.col("n") + 1).alias("line_no"), "line")


_DUCK_RECORDS = f"""o as (select o_orderkey as k, cast(o_orderkey % 5 as int) as capture_id from orders),
c as (select *, {_STRAY} as stray, {_EMPTY} as bare, k % 3 + 1 as depth from o),
e as (select *, 2 + case when stray then 2 else 0 end + case when bare then 0 else depth + case when {_NOTE} or {_ADDRESS} then 1 else 0 end + case when {_BAD} then 1 else 0 end end as size from c),
r as (select *, 1 + case when stray then 2 else 0 end + coalesce(sum(size) over (partition by capture_id order by k rows between unbounded preceding and 1 preceding), 0) as seq from e),
fr as (select capture_id, k, seq, unnest(range(depth)) as j from r where not bare),
ff as (select *, case when (k + j) % 13 = 12 then '[unknown]' else 'f' || ((k + j) % 13) || '(int)' end as symbol,
  case when j > 0 and k % 5 = 2 then '[kernel.kallsyms]' when k % 4 = 3 then '/opt/My App (v2)/run' else '/lib/o' || (k % 3) || '.so' end as dso,
  '0x' || lower(printf('%x', k * 16 + j)) as ip, (k + j) % 2 = 0 as placed, j = 0 and {_NOTE} and (k + j) % 2 = 1 as noted from fr),
fa as (select capture_id, k, seq, 2.0 * j as pos, symbol, dso, ip, case when placed then '/src/a.c' when noted then '/src/b.c' end as file, case when placed then j + 1 when noted then 9 end as line,
    noted as inlined, dso = '[kernel.kallsyms]' as kernel, symbol = '[unknown]' as hidden from ff
  union all select capture_id, k, seq, 1.0, 'unknown', 'unknown', null, null, null, false, false, true from r where not bare and {_BAD})"""


def _marked(spark, sf_dir):
    return cut_texts(P.mark_lines(perf_lines(spark, sf_dir)))


@query(
    "perf_text_samples",
    f"""with {_DUCK_RECORDS} select capture_id, cast(seq as bigint) as sample_seq, case when k % 10 = 0 then 'io worker' else 't' || (k % 4) end as thread_name, cast(k % 50 + 1 as int) as process_id,
  k % 50 + case k % 3 when 0 then 2 when 1 then 1 else 3 end as thread_id, case when k % 3 < 2 then cast(k % 8 as int) end as cpu, k + 0.25::double as timestamp,
  case when k % 5 = 0 then 1 else k % 100 + 1 end as weight, case when k % 2 = 0 then 'cycles:u' else 'task-clock' end as event,
  case when k % 5 = 0 then 'sample_count' when k % 2 = 0 then 'cycles' else 'nanoseconds' end as weight_unit, case when k % 5 = 0 then 'sample_count_fallback' else 'perf_period' end as weight_source,
  case k % 4 when 0 then 'user' when 1 then 'kernel' else 'unknown' end as sample_context, depth + case when {_BAD} then 1 else 0 end as frames from r where not bare""",
)
def perf_text_samples(spark, sf_dir):
    samples = P.perf_samples(P.perf_records(_marked(spark, sf_dir)))
    return samples.withColumn("frames", F.size("frames").cast("long"))


@query(
    "perf_text_frames",
    f"""with {_DUCK_RECORDS} select capture_id, cast(seq as bigint) as sample_seq, cast(row_number() over (partition by capture_id, k order by pos desc) - 1 as int) as depth, symbol, dso, ip,
  file as source_file, cast(line as int) as source_line, inlined as is_inline, kernel as is_kernel, hidden as is_unknown from fa""",
)
def perf_text_frames(spark, sf_dir):
    """Frames root first: places from the line itself, from the note below it, and none."""
    samples = P.perf_samples(P.perf_records(_marked(spark, sf_dir)))
    rows = samples.select("capture_id", "sample_seq", F.posexplode("frames").alias("depth", "f"))
    return rows.select("capture_id", "sample_seq", "depth", *[f"f.{c}" for c in ("symbol", "dso", "ip", "source_file", "source_line", "is_inline", "is_kernel", "is_unknown")])


@query(
    "perf_text_counters",
    f"""with {_DUCK_RECORDS} select capture_id, count(*) filter (not bare) as parsed_records, count(*) filter (bare) as rejected_records, cast(2 * count(*) filter (stray) as bigint) as stray_lines,
  count(*) filter (not bare and {_TAIL}) as duplicate_frame_lines, count(*) filter (not bare and {_ADDRESS}) as address_annotation_lines,
  count(*) filter (not bare and {_BAD}) as unreadable_frames, cast(2 * count(*) filter (stray) + count(*) filter (bare) as bigint) as malformed_records from r group by capture_id""",
)
def perf_text_counters(spark, sf_dir):
    marked = _marked(spark, sf_dir)
    return P.perf_diagnostics(marked, P.perf_records(marked)).select(
        "capture_id", "parsed_records", "rejected_records", "stray_lines", "duplicate_frame_lines", "address_annotation_lines", "unreadable_frames", "malformed_records"
    )


@query(
    "invalid_bytes",
    """select event_id, event_id % 3 + 2 * (event_id % 2) as invalid, 2 + 2 * (event_id % 3) + event_id % 2 as characters from events""",
)
def invalid_bytes(spark, sf_dir):
    """Bytes that are no UTF-8: single ones, and a character that breaks off; each run is one mark in the text."""
    e = F.col("event_id")
    line = F.concat(F.lit(b"a").cast("binary"), F.unhex(F.array_join(F.array_repeat(F.lit("FF62"), (e % 3).cast("int")), "")), F.unhex(F.lit("C3A9")), F.when(e % 2 == 1, F.unhex(F.lit("E282"))).otherwise(F.unhex(F.lit(""))))
    rows = views.table(spark, sf_dir, "events").select("event_id", line.cast("string").alias("line"))
    return rows.select("event_id", LN.invalid_byte_count(F.col("line")).cast("long").alias("invalid"), F.length(LN.clean_text(F.col("line"))).cast("long").alias("characters"))
