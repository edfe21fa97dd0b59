"""Folded stacks: ``root;…;leaf weight`` per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.symbols import UNKNOWN, is_unknown_symbol
from gristmill.sources.lines import capture_of, clean_text, numbered_lines, once, read_lines

# white space and what is none, as Unicode has it
_SPACE = r"(?U:[\s\x1c-\x1f])"
_WORD = r"(?U:[^\s\x1c-\x1f])"
# fixed values: the scope of folded weights
WEIGHT_UNIT = "sample_count"
WEIGHT_SOURCE = "folded_weight"

FRAME = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("dso", T.StringType()),
        T.StructField("raw_symbol", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_line", T.IntegerType()),
        T.StructField("source_column", T.IntegerType()),
        T.StructField("is_inline", T.BooleanType()),
        T.StructField("is_kernel", T.BooleanType()),
        T.StructField("is_unknown", T.BooleanType()),
    ]
)


def plain_frame(symbol: Column, dso: Column | None = None) -> Column:
    """A frame of which only the symbol (and object) is known."""
    values = {
        "symbol": symbol,
        "dso": F.lit(UNKNOWN) if dso is None else dso,
        "is_inline": F.lit(False),
        "is_kernel": F.lit(False),
        "is_unknown": is_unknown_symbol(symbol),
    }
    return F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FRAME.fields]
    )


def parse_folded(lines: DataFrame) -> DataFrame:
    """Add ``weight``, ``symbols`` and ``reject`` to a DataFrame with a ``line`` column.

    ``reject`` is null for a good record, ``BLANK`` for an empty line, else the reason code; lines and
    stacks of any length are read.  White space is what Unicode calls so.  All other columns pass
    through; one narrow stage, no Python, and every pattern is tried once per line.
    """
    rows = once(lines, __text=F.regexp_replace(clean_text(F.col("line")), f"^{_SPACE}+|{_SPACE}+$", ""))
    rows = once(
        rows,
        __weight=F.regexp_extract("__text", f"{_SPACE}({_WORD}+)$", 1),
        __stack=F.regexp_replace("__text", f"{_SPACE}+{_WORD}+$", ""),
    )
    rows = once(
        rows,
        weight=F.when(F.col("__weight").rlike("^[+-]?[0-9]+$"), F.col("__weight").try_cast("bigint")),
        symbols=F.when(F.col("__stack").rlike(_SPACE), F.split("__stack", f"{_SPACE}*;{_SPACE}*")).otherwise(
            F.split("__stack", ";")
        ),
    )
    reject = (
        F.when(F.col("__text") == "", "BLANK")
        .when(F.col("__weight") == "", "MISSING_WEIGHT")
        .when(F.col("weight").isNull() | (F.col("weight") <= 0), "INVALID_WEIGHT")
        .when(F.array_contains("symbols", ""), "EMPTY_FRAME")
    )
    return rows.withColumn("reject", reject).drop("__text", "__weight", "__stack")


def folded_samples(parsed: DataFrame, dso: Column | None = None) -> DataFrame:
    """Samples of the good rows of ``parse_folded``; other columns pass through."""
    good = parsed.where(F.col("reject").isNull()).drop("reject", "line")
    return (
        good.withColumn("frames", F.transform("symbols", lambda s: plain_frame(s, dso)))
        .withColumn(
            "path",
            F.transform(
                "symbols", lambda s: F.struct(s.alias("symbol"), (F.lit(UNKNOWN) if dso is None else dso).alias("dso"))
            ),
        )
        .withColumn("event", F.lit(UNKNOWN))
        .withColumn("weight_unit", F.lit(WEIGHT_UNIT))
        .withColumn("weight_source", F.lit(WEIGHT_SOURCE))
        .drop("symbols")
    )


def folded_diagnostics(parsed: DataFrame) -> DataFrame:
    """Parse counters, one row per ``capture_id``."""
    malformed = F.col("reject").isNotNull() & (F.col("reject") != "BLANK")
    return parsed.groupBy("capture_id").agg(
        F.count_if(F.col("reject").isNull()).alias("parsed_records"),
        F.count_if(malformed).alias("malformed_records"),
        F.count_if(F.col("reject").isNotNull()).alias("skipped_records"),
        F.count_if(malformed).alias("warning_count"),
    )


def folded_warnings(parsed: DataFrame) -> DataFrame:
    """Every reject with its line number and whole line."""
    bad = parsed.where(F.col("reject").isNotNull() & (F.col("reject") != "BLANK"))
    return bad.select("capture_id", "line_no", F.col("reject").alias("code"), "line")


def read_folded(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Samples of folded files, one capture per file.  Needs no shuffle; rejects: ``read_folded_parsed``."""
    lines = read_lines(spark, path).select(
        capture_of(F.col("path"), path).alias("capture_id"),
        F.struct("block_start", "row_id").alias("sample_seq"),
        "line",
    )
    return full_samples(folded_samples(parse_folded(lines)))


def read_folded_parsed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parsed lines with line numbers, for diagnostics."""
    lines = numbered_lines(spark, path).select(
        capture_of(F.col("path"), path).alias("capture_id"), "line_no", "line"
    )
    return parse_folded(lines)


def full_samples(samples: DataFrame) -> DataFrame:
    defaults = {
        "process_id": F.lit(None).cast("int"),
        "thread_id": F.lit(None).cast("long"),
        "thread_name": F.lit(UNKNOWN),
        "cpu": F.lit(None).cast("int"),
        "timestamp": F.lit(None).cast("double"),
        "sample_context": F.lit(UNKNOWN),
    }
    return samples.select("*", *[c.alias(n) for n, c in defaults.items() if n not in samples.columns])
