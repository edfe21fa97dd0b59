"""Writing results: partitioned tables, canonical event lines, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.pages import canonical_order

# fixed value: rows of a report table
REPORT_ROWS = 20


def write_table(df: DataFrame, path: str, fmt: str = "parquet", files: int = 8) -> None:
    """Result rows by capture, each capture in at most ``files`` files whatever the number of tasks."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    df.repartition("capture_id", salt).write.mode("overwrite").partitionBy("capture_id").format(fmt).save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored result; a filter on ``capture_id`` prunes directories."""
    return spark.read.format(fmt).load(path)


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON object per event: sorted keys, nulls left out, canonical event order."""
    columns = sorted(events.columns)
    ordered = canonical_order(events)
    return ordered.select(F.to_json(F.struct(*columns)).alias("value"))


def write_event_lines(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("overwrite").text(path)


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _code(name: str) -> Column:
    return F.concat(F.lit("`"), F.col(name), F.lit("`"))


def _percent(name: str) -> Column:
    return F.concat(F.col(name).cast("string"), F.lit("%"))


def _or_na(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("n/a"))


def analysis_report(spots: DataFrame, variants: DataFrame, classes: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    """Markdown rows of the leading hotspots of each capture."""
    categories = classes.groupBy("capture_id", "hotspot_id").agg(
        F.array_join(F.sort_array(F.collect_set("category")), ", ").alias("categories")
    )
    top = (
        spots.where(F.col("rank") <= rows)
        .join(variants.drop("symbol_variants"), ["capture_id", "symbol", "dso"], "left")
        .join(categories, ["capture_id", "hotspot_id"], "left")
    )
    identity = F.concat(
        F.coalesce("symbol_variant_count", F.lit(1)).cast("string"),
        F.when(F.col("symbol_variants_truncated"), "+").otherwise(""),
        F.lit(" raw variant(s)"),
        F.when(F.col("normalization_merged"), "; normalized merge").otherwise(""),
    )
    line = _row(
        F.col("hotspot_id"), _code("symbol"), _code("dso"), _percent("self_percent"),
        _percent("inclusive_percent"), identity, F.coalesce("categories", F.lit("")),
    )
    return top.select("capture_id", "rank", line.alias("line"))


def profile_comparison_report(deltas: DataFrame) -> DataFrame:
    """Markdown rows of hotspot changes, largest first (order by ``size`` and the names)."""
    size = F.greatest(F.abs("self_delta_percent"), F.abs("inclusive_delta_percent"))
    line = _row(
        F.col("status"), _code("symbol"), _code("dso"), _percent("baseline_self_percent"),
        _percent("candidate_self_percent"), F.col("self_delta_percent").cast("string"),
        _percent("baseline_inclusive_percent"), _percent("candidate_inclusive_percent"),
        F.col("inclusive_delta_percent").cast("string"), _or_na("rank_delta"),
    )
    return deltas.select(size.alias("size"), "symbol", "dso", line.alias("line"))


def benchmark_comparison_report(deltas: DataFrame) -> DataFrame:
    """Markdown rows of metric changes."""
    samples = F.concat_ws("/", "baseline_samples", "candidate_samples")
    significant = F.coalesce(F.col("statistically_significant").cast("string"), F.lit("insufficient data"))
    line = _row(
        _code("metric"), F.col("unit"), samples, F.col("baseline_median").cast("string"),
        F.col("candidate_median").cast("string"), F.concat(_or_na("improvement_percent"), F.lit("%")),
        significant, F.col("practically_significant").cast("string"), _code("status"),
    )
    return deltas.select("metric", line.alias("line"))
