"""Benchmark statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.distribution import medians


def metric_stats(values: DataFrame, keys: list[str]) -> DataFrame:
    """Samples, median, mean and sample deviation (0 for one value) per ``keys``.

    ``unit`` and ``higher_is_better`` pass through where present.
    """
    extra = [F.first(c).alias(c) for c in ("unit", "higher_is_better") if c in values.columns]
    moments = values.groupBy(*keys).agg(
        *extra,
        F.count("value").alias("samples"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("standard_deviation"),
    )
    return moments.join(medians(values, keys, "value"), keys)
