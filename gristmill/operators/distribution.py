"""Exact order statistics without holding a group in one buffer.

``percentile_disc`` and ``median`` keep every distinct value of a group in one aggregation buffer.
Here equal values are counted first (partial aggregation), the counts are scanned in value order
in spans of bounded width, and the wanted ranks are read off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: the percentiles every distribution reports, and the column order of one distribution
PERCENTILES = (50, 95, 99)
FIELDS = ("sample_count", "total_ns", "minimum_ns", "mean_ns", "p50_ns", "p95_ns", "p99_ns", "max_ns")


def _value_span(value: Column) -> Column:
    """A bucket that never decreases as ``value`` grows: 4096 per factor of e, by sign."""
    size = F.floor((F.ln(F.abs(value.cast("double"))) + 745.0) * 4096.0) + 1
    return F.when(value == 0, F.lit(0).cast("long")).otherwise(F.signum(value.cast("double")).cast("long") * size)


def ranked_counts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Per key the distinct non-null values with the ranks they cover: ``__value, __n, __lo, __hi, __all``.

    The sorted values of a key with rank in (lo, hi] equal ``__value``; ``__all`` is the row count.
    """
    counted = (
        df.select(*keys, value.alias("__value"))
        .where(F.col("__value").isNotNull())
        .groupBy(*keys, "__value")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__b", _value_span(F.col("__value")))
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    buckets = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counted.groupBy(*keys, "__b")
        .agg(F.sum("__n").alias("__bn"))
        .select(
            *keys,
            "__b",
            F.coalesce(F.sum("__bn").over(buckets), F.lit(0)).alias("__before"),
            F.sum("__bn").over(Window.partitionBy(*keys)).alias("__all"),
        )
    )
    return (
        counted.withColumn("__cum", F.sum("__n").over(inside))
        .join(starts, [*keys, "__b"])
        .withColumn("__hi", F.col("__before") + F.col("__cum"))
        .withColumn("__lo", F.col("__hi") - F.col("__n"))
        .select(*keys, "__value", "__n", "__lo", "__hi", "__all")
    )


def at_rank(rank: Column) -> Column:
    """Aggregate over ``ranked_counts``: the value at 1-based ``rank``."""
    return F.max(F.when((F.col("__lo") < rank) & (rank <= F.col("__hi")), F.col("__value")))


def distributions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key: ``sample_count … max_ns`` of the non-null ``value``.

    Percentiles are nearest rank, ceil(p * n / 100); the mean is floored.
    """
    picks = [
        at_rank(F.floor((F.lit(p) * F.col("__all") + 99) / F.lit(100))).alias(f"p{p}_ns") for p in PERCENTILES
    ]
    return (
        ranked_counts(df, keys, F.col(value).cast("long"))
        .groupBy(*keys)
        .agg(
            F.sum("__n").alias("sample_count"),
            F.sum(F.col("__value") * F.col("__n")).alias("total_ns"),
            F.min("__value").alias("minimum_ns"),
            *picks,
            F.max("__value").alias("max_ns"),
        )
        .withColumn("mean_ns", F.expr("total_ns div sample_count"))
        .select(*keys, *FIELDS)
    )


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per key (mean of the two middle values)."""
    n = F.col("__all")
    return (
        ranked_counts(df, keys, F.col(value).cast("double"))
        .groupBy(*keys)
        .agg(
            at_rank(F.floor((n + 1) / F.lit(2))).alias("__low"),
            at_rank(F.floor(n / F.lit(2)) + 1).alias("__high"),
        )
        .select(*keys, ((F.col("__low") + F.col("__high")) / 2).alias("median"))
    )


def wide_distributions(
    long: DataFrame,
    keys: list[str],
    measure: str,
    value: str,
    measures: dict[str, str],
    empty_percentile: int | None = None,
) -> DataFrame:
    """Spread the measures of a long table into prefixed columns, one row per key.

    ``measures`` maps a value of the ``measure`` column to a column prefix.  Groups without rows
    get zero counts and ``empty_percentile`` (null in traces, zero in runtime locks).
    """
    dist = distributions(long, [*keys, measure], value)
    aggs = [
        F.max(F.when(F.col(measure) == name, F.col(field))).alias(f"{prefix}_{field}")
        for name, prefix in measures.items()
        for field in FIELDS
    ]
    return fill_empty(dist.groupBy(*keys).agg(*aggs), list(measures.values()), empty_percentile)


def fill_empty(df: DataFrame, prefixes: list[str], empty_percentile: int | None = None) -> DataFrame:
    """Zero counts, totals, minima and means where a distribution saw no row."""
    zeros = {f"{p}_{f}": 0 for p in prefixes for f in FIELDS[:4]}
    if empty_percentile is not None:
        zeros |= {f"{p}_{f}": empty_percentile for p in prefixes for f in FIELDS[4:]}
    return df.fillna(zeros)
