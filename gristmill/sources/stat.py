"""Counter rows: ``value;unit;event;run_time;running_percent`` per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.lines import capture_of, clean_text, invalid_byte_count, numbered_lines, once

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _field(fields: Column, index: int) -> Column:
    """The unquoted, trimmed field at 0-based ``index``; null past the end."""
    raw = F.trim(F.get(fields, F.lit(index)))
    return F.trim(F.regexp_replace(raw, r'^"(.*)"$', "$1"))


def parse_stat(lines: DataFrame) -> DataFrame:
    """Add ``event, value, unit, run_time_ns, running_percent, status`` and ``reject`` to ``line`` rows.

    Blank lines and comments get reject ``SKIP``; other rejects are rows that must be warned about.
    """
    rows = once(lines, __text=F.regexp_replace(F.col("line"), r"^\s+|\s+$", ""))
    text = F.col("__text")
    rows = once(rows, __fields=F.split(text, ";"))
    fields = F.col("__fields")
    rows = once(rows, __value=_field(fields, 0), event=_field(fields, 2), unit=_field(fields, 1),
                __run=_field(fields, 3), __percent=F.regexp_replace(_field(fields, 4), r"%+$", ""))
    lowered = F.lower(F.col("__value"))
    status = (
        F.when(F.contains(lowered, F.lit("not supported")), "not_supported")
        .when(F.contains(lowered, F.lit("not counted")), "not_counted")
        .otherwise("measured")
    )
    rows = once(rows, status=status, __number=_number(F.col("__value")), __run_ns=F.floor(_number(F.col("__run"))),
                __pct=_number(F.col("__percent")))
    measured, number = F.col("status") == "measured", F.col("__number")
    reject = (
        F.when((text == "") | F.startswith(text, F.lit("#")), "SKIP")
        .when(F.size(fields) < 3, "TOO_FEW_FIELDS")
        .when(F.col("event") == "", "NO_EVENT")
        .when(measured & number.isNull(), "INVALID_VALUE")
    )
    rows = once(
        rows,
        value=F.when(measured, number),
        run_time_ns=F.when(F.col("__run_ns") >= 0, F.col("__run_ns")),
        running_percent=F.when((F.col("__pct") >= 0) & (F.col("__pct") <= 100), F.col("__pct")),
        reject=reject,
    )
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def read_stat(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parsed rows of counter files, one capture per file; invalid UTF-8 is counted per row."""
    lines = numbered_lines(spark, path).select(
        capture_of(F.col("path"), path).alias("capture_id"),
        "line_no",
        clean_text(F.col("line")).alias("line"),
        invalid_byte_count(F.col("line")).alias("invalid_bytes"),
    )
    return parse_stat(lines)


def stat_metrics(parsed: DataFrame) -> DataFrame:
    """The good rows as metrics."""
    return parsed.where(F.col("reject").isNull()).select(
        "capture_id",
        *[c for c in ("line_no",) if c in parsed.columns],
        "event",
        "value",
        "unit",
        "run_time_ns",
        "running_percent",
        F.lit(False).alias("derived"),
        "status",
    )
