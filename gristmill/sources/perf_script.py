"""Profiler text: one header line and its indented frames per sample.

Lines keep a per-file order, so a file may be read by many tasks; which record and which frame a
line belongs to are running values over the line order, computed in spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.symbols import UNKNOWN, normalize_symbol, perf_period_unit
from gristmill.operators.ordered import count_since, cut_texts, running, running_last
from gristmill.sources.folded import FRAME
from gristmill.sources.lines import capture_of, clean_text, invalid_byte_count, numbered_lines

# fixed values: forms of header, frame and annotation lines
_TAIL = r"(?:([A-Za-z.]+)\s+)?(\d+(?:\.\d+)?):\s+(?:(\d+)\s+)?(\S+):(?:\s+(.*))?$"
HEADERS = (
    r"^(.*?)\s+(\d+)/(\d+)\s+\[(\d+)\]\s+" + _TAIL,
    r"^(.*?)\s+(\d+)\s+(\d+)\s+\[(\d+)\]\s+" + _TAIL,
    r"^(.*?)\s+(\d+)()\s+\[(\d+)\]\s+" + _TAIL,
    r"^(.*?)\s+(\d+)/(\d+)()\s+" + _TAIL,
    r"^(.*?)\s+(\d+)\s+(\d+)()\s+" + _TAIL,
    r"^(.*?)\s+(\d+)()()\s+" + _TAIL,
)
HEADER_SIGN = r"\d:\s"  # in every header, and quick to look for
FRAME_LINE = r"^(?:0x)?([0-9a-fA-F]+)\s+(.+)$"
ADDRESS_NOTE = r"^(.+)\[([0-9a-fA-F]+)\]$"
SOURCE_NOTE = r"^(.+:\d+(?::\d+)?)(\s+\(inlined\))?$"
MISSING_SOURCE = r"^\?\?:(?:0|\?)$"
SOURCE = r"^(.*?):(\d+)(?::(\d+))?$"
PERF_MAP = r"^perf-\d+\.map$"
NO_SOURCE = ("??", "??:0")
KERNEL_OBJECTS = ("[kernel.kallsyms]", "[kernel]")
UNKNOWN_NAMES = ("[unknown]", "unknown", "0", "??")


def _header_parts(line: Column) -> Column:
    """The nine parts of the first matching header form, null for any other line.

    One replacement takes all parts out; no part holds a line break.
    """
    out = None
    for pattern in HEADERS:
        parts = F.split(F.regexp_replace(line, pattern + r"[\s\S]*", "\n".join(f"${i}" for i in range(1, 10))), "\n")
        condition = line.rlike(HEADER_SIGN) & line.rlike(pattern)
        out = F.when(condition, parts) if out is None else out.when(condition, parts)
    return out


def _header(parts: Column) -> Column:
    """``_header_parts`` as a struct."""

    def part(i: int) -> Column:
        return F.nullif(F.get(parts, F.lit(i - 1)), F.lit(""))

    found = F.struct(
        F.coalesce(F.nullif(F.trim(part(1)), F.lit("")), F.lit(UNKNOWN)).alias("command"),
        part(2).try_cast("int").alias("pid"),
        F.coalesce(part(3), part(2)).try_cast("bigint").alias("tid"),
        part(4).try_cast("int").alias("cpu"),
        part(5).alias("misc"),
        part(6).try_cast("double").alias("time"),
        part(7).try_cast("bigint").alias("period"),
        part(8).alias("event"),
        F.trim(F.coalesce(part(9), F.lit(""))).alias("tail"),
    )
    return F.when(parts.isNotNull(), found)


def sample_context(misc: Column) -> Column:
    """Privilege of a sample from the first letter of its ``misc`` field."""
    first = F.upper(F.substring(misc, 1, 1))
    return F.when(first == "U", "user").when(first == "K", "kernel").otherwise("unknown")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalized_ip(ip: Column) -> Column:
    """Lower case, without ``0x`` and leading zeros."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(ip), "^0x", ""), "^0+", "")
    return F.when(digits == "", "0").otherwise(digits)


def _closing(text: Column) -> Column:
    """1-based place of the parenthesis that closes the one ``text`` starts with; 0 if none does."""
    end = F.aggregate(
        F.split(text, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("close")),
        lambda acc, ch: F.struct(
            (acc["depth"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)).alias("depth"),
            (acc["at"] + F.when(ch == "", 0).otherwise(1)).alias("at"),
            F.when(
                (acc["close"] == 0) & (ch == ")") & (acc["depth"] == 1), acc["at"] + 1
            ).otherwise(acc["close"]).alias("close"),
        ),
    )
    return end["close"]


def _body_parts(symbol: Column, dso: Column, suffix: Column) -> Column:
    return F.struct(
        F.coalesce(F.nullif(F.trim(symbol), F.lit("")), F.lit(UNKNOWN)).alias("raw_symbol"),
        F.coalesce(F.nullif(F.trim(dso), F.lit("")), F.lit(UNKNOWN)).alias("dso"),
        F.when(suffix.rlike(SOURCE_NOTE), F.regexp_extract(suffix, SOURCE_NOTE, 1))
        .when(suffix != "", suffix)
        .alias("source"),
        (suffix.rlike(SOURCE_NOTE) & (F.regexp_extract(suffix, SOURCE_NOTE, 2) != "")).alias("is_inline"),
    )


def _valid_suffix(suffix: Column) -> Column:
    return (suffix == "") | suffix.rlike(SOURCE_NOTE) | suffix.isin(*NO_SOURCE)


def split_body(body: Column) -> Column:
    """``symbol (object) [source]`` as a struct, null when it cannot be split.

    Nearly all bodies have one `` (`` and no nested parentheses: one regex.  The others try each
    `` (`` from the left with balanced parentheses.
    """
    simple = r"^((?:(?! \().)*) \(([^()]*)\)(.*)$"
    suffix = F.trim(F.regexp_extract(body, simple, 3))
    quick = body.rlike(simple) & _valid_suffix(suffix)

    places = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(body) - 1, F.lit(1))),
        lambda i: F.substr(body, i, F.lit(2)) == " (",
    )
    tries = F.transform(places, lambda at: F.struct(at.alias("at"), F.substr(body, at + 1).alias("rest")))
    tries = F.transform(
        tries, lambda t: F.struct(t["at"].alias("at"), t["rest"].alias("rest"), _closing(t["rest"]).alias("close"))
    )
    tries = F.transform(
        F.filter(tries, lambda t: t["close"] > 0),
        lambda t: F.struct(
            F.substr(body, F.lit(1), t["at"] - 1).alias("symbol"),
            F.substr(t["rest"], F.lit(2), t["close"] - 2).alias("dso"),
            F.trim(F.substr(t["rest"], t["close"] + 1)).alias("suffix"),
        ),
    )
    found = F.filter(tries, lambda t: _valid_suffix(t["suffix"]))
    slow = F.get(F.transform(found, lambda t: _body_parts(t["symbol"], t["dso"], t["suffix"])), F.lit(0))
    return F.when(
        quick, _body_parts(F.regexp_extract(body, simple, 1), F.regexp_extract(body, simple, 2), suffix)
    ).otherwise(slow)


def parse_source(source: Column) -> dict[str, Column]:
    """File, line and column of ``file:line[:column]``; a line of 0 means none."""
    known = source.isNotNull() & ~source.isin(*NO_SOURCE)
    matched = source.rlike(SOURCE)
    line = F.when(matched, F.regexp_extract(source, SOURCE, 2).try_cast("int"))
    column = F.nullif(F.regexp_extract(source, SOURCE, 3), F.lit("")).try_cast("int")
    line = F.when(known & (line > 0), line)
    return {
        "source_file": F.when(known & matched, F.regexp_extract(source, SOURCE, 1)).when(known, source),
        "source_line": line,
        "source_column": F.when(line.isNotNull() & (column > 0), column),
    }


def _frame(values: dict[str, Column]) -> Column:
    return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in FRAME.fields])


def with_frame(rows: DataFrame) -> DataFrame:
    """Add ``frame`` from ``text`` (``ip symbol (object) [source]``); unreadable text becomes ``unknown``.

    In steps, so that no step repeats the expressions of the one before.
    """
    named = r"^(py::[^:]*):(.+)$"
    text, body, parts, raw, dso = (F.col(c) for c in ("text", "__body", "__parts", "__raw", "__dso"))
    mapped = parts["source"].isNull() & raw.rlike(named) & base_name(dso).rlike(PERF_MAP)
    staged = (
        rows.withColumn("__body", F.trim(F.regexp_extract(text, FRAME_LINE, 2)))
        .withColumn("__parts", split_body(body))
        .withColumn("__raw", F.coalesce(parts["raw_symbol"], F.nullif(body, F.lit("")), F.lit(UNKNOWN)))
        .withColumn("__dso", F.coalesce(parts["dso"], F.lit(UNKNOWN)))
        .withColumn("__mapped", F.coalesce(mapped, F.lit(False)))
        .withColumn(
            "__symbol",
            normalize_symbol(F.when(F.col("__mapped"), F.regexp_extract(raw, named, 1)).otherwise(raw)),
        )
        .withColumn(
            "__source", F.when(F.col("__mapped"), F.regexp_extract(raw, named, 2)).otherwise(parts["source"])
        )
    )
    symbol, none = F.col("__symbol"), F.lit(None)
    good = _frame(
        {
            "symbol": symbol,
            "dso": dso,
            "raw_symbol": raw,
            "ip": F.concat(F.lit("0x"), F.lower(F.regexp_extract(text, FRAME_LINE, 1))),
            **parse_source(F.col("__source")),
            "is_inline": F.coalesce(parts["is_inline"], F.lit(False)),
            "is_kernel": dso.isin(*KERNEL_OBJECTS) | F.contains(raw, F.lit("[k]")),
            "is_unknown": symbol.isin(*UNKNOWN_NAMES) | dso.isin("[unknown]", UNKNOWN),
        }
    )
    unknown = _frame(
        {
            "symbol": F.lit(UNKNOWN),
            "dso": F.lit(UNKNOWN),
            "raw_symbol": F.lit("[unparsed-frame]"),
            "ip": none,
            "source_file": none,
            "source_line": none,
            "source_column": none,
            "is_inline": F.lit(False),
            "is_kernel": F.lit(False),
            "is_unknown": F.lit(True),
        }
    )
    return staged.withColumn("frame", F.when(text.rlike(FRAME_LINE), good).otherwise(unknown)).drop(
        *[c for c in staged.columns if c.startswith("__")]
    )


def mark_lines(lines: DataFrame) -> DataFrame:
    """Add the role of each line: record, frame, kind and header struct.

    Input: ``capture_id, line_no, line`` (line numbers dense per capture).
    """
    line = F.regexp_replace(clean_text(F.col("line")), r"[\r\n]+$", "")
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    indented = line.rlike(r"^\s")
    header = F.col("header")
    rows = lines.withColumn("line", line).withColumn("__parts", _header_parts(F.col("line"))).withColumn("text", text)
    rows = rows.withColumn("header", _header(F.col("__parts"))).drop("__parts")
    kind = (
        F.when(F.col("text") == "", "blank")
        .when(header.isNotNull(), "header")
        .when(~indented, "other")
        .when(F.col("text").rlike(FRAME_LINE), "frame")
        .when(F.col("text").rlike(ADDRESS_NOTE), "address_note")
        .when(F.col("text").rlike(MISSING_SOURCE), "missing_source")
        .when(F.col("text").rlike(SOURCE_NOTE), "source_note")
        .otherwise("unreadable")
    )
    # the running values read their rows twice; lines are read and matched once
    rows = cut_texts(rows.withColumn("kind", kind))
    kind = F.col("kind")
    has_frame = kind.isin("frame", "unreadable") | ((kind == "header") & (F.col("header.tail") != ""))
    rows = running(
        rows,
        ["capture_id"],
        "line_no",
        {
            "record": running_last(F.when(kind == "header", F.col("line_no"))),
            "stop": running_last(F.when(kind.isin("blank", "other"), F.col("line_no"))),
            "frame_line": running_last(F.when(has_frame, F.col("line_no"))),
            "position": count_since(has_frame & (kind != "header"), kind == "header"),
        },
    )
    inside = (F.col("record").isNotNull() & (F.coalesce("stop", F.lit(-1)) < F.col("record")))
    record = F.when((kind == "header") | (inside & ~kind.isin("blank", "other")), F.col("record"))
    return rows.withColumn("record", record).withColumn(
        "frame_line", F.when(F.col("frame_line") >= F.col("record"), F.col("frame_line"))
    )


def perf_frames(marked: DataFrame) -> DataFrame:
    """One row per frame: (capture_id, record, frame_line) with its frame and its annotation."""
    kind = F.col("kind")
    own = F.when(kind == "header", F.col("tail")).otherwise(F.col("text"))
    is_frame = F.col("line_no") == F.col("frame_line")
    note = F.when((kind == "source_note") & ~is_frame, F.struct("line_no", "text"))
    grouped = (
        # dealt by record, as the stacks are: one shuffle for both
        marked.where(F.col("record").isNotNull() & F.col("frame_line").isNotNull())
        .select("capture_id", "record", "frame_line", "line_no", "kind", "text", "header.tail")
        .repartition("capture_id", "record")
        .groupBy("capture_id", "record", "frame_line")
        .agg(
            F.max(F.when(is_frame, own)).alias("text"),
            F.min(note).alias("note"),
            F.bool_or(is_frame & (kind == "header")).alias("from_header"),
        )
    )
    parsed = with_frame(grouped)
    source = parse_source(F.regexp_extract("note.text", SOURCE_NOTE, 1))
    enrich = (
        F.col("note").isNotNull()
        & F.col("frame.source_file").isNull()
        & source["source_file"].isNotNull()
        & source["source_line"].isNotNull()
    )
    frame = F.col("frame")
    enriched = F.struct(
        *[
            {
                **{n: frame[n] for n in FRAME.fieldNames()},
                **source,
                "is_inline": F.regexp_extract("note.text", SOURCE_NOTE, 2) != "",
            }[f.name].cast(f.dataType).alias(f.name)
            for f in FRAME.fields
        ]
    )
    return parsed.select(
        "capture_id",
        "record",
        "frame_line",
        "from_header",
        enrich.alias("annotated"),
        F.when(enrich, enriched).otherwise(frame).alias("frame"),
    )


def perf_records(marked: DataFrame) -> DataFrame:
    """One row per header line: its fields, the frames root first, and ``reject``."""
    headers = marked.where(F.col("kind") == "header").select(
        "capture_id", F.col("line_no").alias("record"), "header"
    )
    stacks = (
        perf_frames(marked)
        .groupBy("capture_id", "record")
        .agg(
            F.sort_array(F.collect_list(F.struct("frame_line", "from_header", "annotated", "frame"))).alias("fs")
        )
    )
    first, second = F.get("fs", F.lit(0)), F.get("fs", F.lit(1))
    repeated = F.coalesce(
        first["from_header"]
        & ~first["annotated"]
        & (normalized_ip(first["frame"]["ip"]) == normalized_ip(second["frame"]["ip"]))
        & (first["frame"]["raw_symbol"] == second["frame"]["raw_symbol"])
        & (first["frame"]["dso"] == second["frame"]["dso"]),
        F.lit(False),
    )
    rows = headers.join(stacks, ["capture_id", "record"], "left").withColumn("repeated", repeated)
    kept = F.when(F.col("repeated"), F.slice("fs", 2, F.size("fs"))).otherwise(F.col("fs"))
    frames = F.reverse(F.transform(kept, lambda f: f["frame"]))
    return rows.select(
        "capture_id",
        "record",
        "header",
        "repeated",
        frames.alias("frames"),
        F.when(F.col("fs").isNull(), "MISSING_CALLCHAIN").alias("reject"),
    )


def perf_samples(records: DataFrame) -> DataFrame:
    """Stack samples of the good records."""
    h = F.col("header")
    with_period = h["period"].isNotNull()
    return records.where(F.col("reject").isNull()).select(
        "capture_id",
        F.col("record").alias("sample_seq"),
        "frames",
        F.coalesce(h["period"], F.lit(1)).cast("bigint").alias("weight"),
        h["event"].alias("event"),
        F.when(with_period, perf_period_unit(h["event"])).otherwise("sample_count").alias("weight_unit"),
        F.when(with_period, "perf_period").otherwise("sample_count_fallback").alias("weight_source"),
        h["pid"].alias("process_id"),
        h["tid"].alias("thread_id"),
        h["command"].alias("thread_name"),
        h["cpu"].alias("cpu"),
        h["time"].alias("timestamp"),
        sample_context(h["misc"]).alias("sample_context"),
    )


def perf_diagnostics(marked: DataFrame, records: DataFrame) -> DataFrame:
    """Parse counters, one row per capture."""
    kind = F.col("kind")
    stray = (kind == "other") | (F.col("record").isNull() & ~kind.isin("blank", "header", "other"))
    is_frame = (F.col("line_no") == F.col("frame_line")) & F.col("record").isNotNull()
    by_line = marked.groupBy("capture_id").agg(
        F.count_if(stray).alias("stray_lines"),
        F.count_if(F.coalesce(is_frame, F.lit(False))).alias("frame_lines"),
        F.count_if((kind == "address_note") & F.col("record").isNotNull()).alias("address_annotation_lines"),
        F.count_if((kind == "unreadable") & F.col("record").isNotNull()).alias("unreadable_frames"),
    )
    by_record = records.groupBy("capture_id").agg(
        F.count_if(F.col("reject").isNull()).alias("parsed_records"),
        F.count_if(F.col("reject").isNotNull()).alias("rejected_records"),
        F.count_if("repeated").alias("duplicate_frame_lines"),
    )
    return (
        by_line.join(by_record, "capture_id", "left")
        .fillna(0)
        .withColumn("malformed_records", F.col("stray_lines") + F.col("rejected_records"))
        .withColumn("warning_count", F.col("malformed_records") + F.col("unreadable_frames"))
    )


def read_perf_script(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(samples, diagnostics) of profiler text files, one capture per file."""
    lines = numbered_lines(spark, path).select(
        capture_of(F.col("path"), path).alias("capture_id"), "line_no", "line"
    )
    marked = cut_texts(mark_lines(lines))
    records = perf_records(marked)
    broken = lines.groupBy("capture_id").agg(
        F.sum(invalid_byte_count(F.col("line"))).alias("unicode_replacement_count")
    )
    return perf_samples(records), perf_diagnostics(marked, records).join(broken, "capture_id", "left")
