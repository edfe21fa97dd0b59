"""Baseline-versus-candidate comparisons of profiles, benchmarks, conditions and verdicts.

Every function takes two DataFrames (or one with prefixed columns) and ``pair``, the columns that
say which baseline belongs to which candidate; many pairs are one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: thresholds of the verdicts
MIN_DELTA_PERCENT = 1.0
MIN_PRACTICAL_PERCENT = 1.0
MIN_MATERIAL_PERCENT = 1.0
FEW_SAMPLES = 100
Z_95 = 1.96


def _outer(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer join on ``keys`` with prefixed columns and presence flags."""
    left = before.select(*keys, *[F.col(c).alias(f"baseline_{c}") for c in columns], F.lit(True).alias("__b"))
    right = after.select(*keys, *[F.col(c).alias(f"candidate_{c}") for c in columns], F.lit(True).alias("__c"))
    return left.join(right, keys, "full_outer")


def _status() -> Column:
    return F.when(F.col("__b").isNull(), "added").when(F.col("__c").isNull(), "removed").otherwise("changed")


def _delta(column: str) -> Column:
    return F.coalesce(f"candidate_{column}", F.lit(0.0)) - F.coalesce(f"baseline_{column}", F.lit(0.0))


def profile_diff(
    before: DataFrame, after: DataFrame, pair: Sequence[str] = (), min_delta: float = MIN_DELTA_PERCENT
) -> DataFrame:
    """Exported hotspots that appeared, vanished or moved by at least ``min_delta`` points."""
    rows = _outer(before, after, [*pair, "symbol", "dso"], ["self_percent", "inclusive_percent", "rank"])
    moved = F.greatest(F.abs(_delta("self_percent")), F.abs(_delta("inclusive_percent")))
    zero = F.lit(0.0)
    return (
        rows.where(F.col("__b").isNull() | F.col("__c").isNull() | (moved >= min_delta))
        .select(
            *pair,
            "symbol",
            "dso",
            _status().alias("status"),
            F.coalesce("baseline_self_percent", zero).alias("baseline_self_percent"),
            F.coalesce("candidate_self_percent", zero).alias("candidate_self_percent"),
            F.bround(_delta("self_percent"), 6).alias("self_delta_percent"),
            F.coalesce("baseline_inclusive_percent", zero).alias("baseline_inclusive_percent"),
            F.coalesce("candidate_inclusive_percent", zero).alias("candidate_inclusive_percent"),
            F.bround(_delta("inclusive_percent"), 6).alias("inclusive_delta_percent"),
            "baseline_rank",
            "candidate_rank",
            (F.col("baseline_rank") - F.col("candidate_rank")).alias("rank_delta"),
        )
    )


def order_hotspot_deltas(deltas: DataFrame) -> DataFrame:
    size = F.greatest(F.abs("self_delta_percent"), F.abs("inclusive_delta_percent"))
    return deltas.orderBy(size.desc(), "symbol", "dso")


def path_diff(
    before: DataFrame, after: DataFrame, pair: Sequence[str] = (), min_delta: float = MIN_DELTA_PERCENT
) -> DataFrame:
    """Exported call paths that appeared, vanished or moved by at least ``min_delta`` points."""
    rows = _outer(before, after, [*pair, "path"], ["percent"])
    return rows.where(
        F.col("__b").isNull() | F.col("__c").isNull() | (F.abs(_delta("percent")) >= min_delta)
    ).select(
        *pair,
        "path",
        _status().alias("status"),
        F.coalesce("baseline_percent", F.lit(0.0)).alias("baseline_percent"),
        F.coalesce("candidate_percent", F.lit(0.0)).alias("candidate_percent"),
        F.bround(_delta("percent"), 6).alias("delta_percent"),
    )


def order_path_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.orderBy(F.abs("delta_percent").desc(), F.transform("path", lambda f: f["symbol"]))


def dso_changes(before: DataFrame, after: DataFrame, pair: Sequence[str] = ()) -> DataFrame:
    """Symbols whose set of objects differs between the two exports."""
    keys = [*pair, "symbol"]

    def objects(rows: DataFrame) -> DataFrame:
        return (
            rows.select(*keys, "dso").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("dso")).alias("dsos"))
        )

    none = F.array().cast("array<string>")
    rows = _outer(objects(before), objects(after), keys, ["dsos"])
    return rows.select(
        *keys,
        F.coalesce("baseline_dsos", none).alias("baseline_dsos"),
        F.coalesce("candidate_dsos", none).alias("candidate_dsos"),
    ).where(F.col("baseline_dsos") != F.col("candidate_dsos"))


def condition_diff(before: DataFrame, after: DataFrame, pair: Sequence[str] = (), fields: str = "fields") -> DataFrame:
    """Fields of two string maps that differ; a missing field counts as null."""
    keys = [*pair, "field"]

    def long(rows: DataFrame) -> DataFrame:
        return rows.select(*pair, F.explode(F.map_entries(fields)).alias("e")).select(
            *pair, F.col("e.key").alias("field"), F.col("e.value").alias("value")
        )

    return (
        _outer(long(before), long(after), keys, ["value"])
        .where(~F.col("baseline_value").eqNullSafe(F.col("candidate_value")))
        .select(*keys, "baseline_value", "candidate_value")
    )


def profile_comparability(before: DataFrame, after: DataFrame, pair: Sequence[str]) -> DataFrame:
    """One row per pair: differing metadata fields, whether comparable, few-samples warning.

    Input rows carry ``fields`` (map of metadata and provenance), ``quality_status`` and
    ``sample_count``; one row per pair on each side.
    """
    keys = list(pair)
    diffs = condition_diff(before, after, pair).groupBy(*keys).agg(
        F.sort_array(F.collect_list("field")).alias("differences")
    )
    sides = _outer(before, after, keys, ["quality_status", "sample_count"])
    quality = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"{side}_quality_status") != "verified", f"{side}_quality_status")
                for side in ("baseline", "candidate")
            ]
        )
    )
    none = F.array().cast("array<string>")
    return (
        sides.join(diffs, keys, "left")
        .withColumn("differences", F.concat(F.coalesce("differences", none), quality))
        .select(
            *keys,
            "differences",
            (F.size("differences") == 0).alias("comparable"),
            (F.least("baseline_sample_count", "candidate_sample_count") < FEW_SAMPLES).alias("few_samples"),
        )
    )


def benchmark_diff(
    before: DataFrame,
    after: DataFrame,
    pair: Sequence[str] = (),
    comparable: Column | None = None,
    min_practical: float = MIN_PRACTICAL_PERCENT,
) -> DataFrame:
    """Verdict per common metric.

    Input rows are ``bench.metric_stats``: ``metric, unit, higher_is_better, samples, median, mean,
    standard_deviation``.  The interval is on the means, the delta on the medians; too few samples
    is decided before comparability.
    """
    columns = ["unit", "higher_is_better", "samples", "median", "mean", "standard_deviation"]
    left = before.select(*pair, "metric", *[F.col(c).alias(f"baseline_{c}") for c in columns])
    right = after.select(*pair, "metric", *[F.col(c).alias(f"candidate_{c}") for c in columns])
    rows = left.join(right, [*pair, "metric"])
    b = {c: F.col(f"baseline_{c}") for c in columns}
    a = {c: F.col(f"candidate_{c}") for c in columns}
    same_metric = (b["unit"] == a["unit"]) & (b["higher_is_better"] == a["higher_is_better"])
    if comparable is not None:
        same_metric = comparable & same_metric
    raw = F.when(b["median"] != 0, (a["median"] - b["median"]) * 100 / F.abs(b["median"]))
    improvement = F.when(b["higher_is_better"], raw).otherwise(-raw)
    enough = (b["samples"] >= 3) & (a["samples"] >= 3)
    error = F.sqrt(
        b["standard_deviation"] * b["standard_deviation"] / b["samples"]
        + a["standard_deviation"] * a["standard_deviation"] / a["samples"]
    )
    difference = a["mean"] - b["mean"]
    low = F.when(enough, F.bround(difference - Z_95 * error, 9))
    high = F.when(enough, F.bround(difference + Z_95 * error, 9))
    practical = F.coalesce(F.abs(improvement) >= min_practical, F.lit(False))
    significant = (low > 0) | (high < 0)
    return rows.select(
        *pair,
        "metric",
        b["unit"].alias("unit"),
        b["samples"].alias("baseline_samples"),
        a["samples"].alias("candidate_samples"),
        b["median"].alias("baseline_median"),
        a["median"].alias("candidate_median"),
        F.bround(raw, 6).alias("raw_delta_percent"),
        F.bround(improvement, 6).alias("improvement_percent"),
        low.alias("interval_low"),
        high.alias("interval_high"),
        significant.alias("statistically_significant"),
        practical.alias("practically_significant"),
        F.when(~enough, "insufficient_data")
        .when(~same_metric, "not_comparable")
        .when(~practical | ~significant, "no_material_change")
        .when(improvement > 0, "candidate_improvement")
        .otherwise("candidate_regression")
        .alias("status"),
    )


def unmatched_metrics(before: DataFrame, after: DataFrame, pair: Sequence[str] = ()) -> DataFrame:
    """Metrics only one side reports."""
    keys = [*pair, "metric"]
    return (
        before.select(*keys)
        .join(after, keys, "left_anti")
        .withColumn("only_in", F.lit("baseline"))
        .unionByName(after.select(*keys).join(before, keys, "left_anti").withColumn("only_in", F.lit("candidate")))
    )


def metric_lists(deltas: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Improved and regressed metric names per pair, sorted."""

    def names(status: str, name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("status") == status, F.col("metric")))).alias(name)

    return deltas.groupBy(*pair).agg(
        names("candidate_improvement", "improved_metrics"),
        names("candidate_regression", "regressed_metrics"),
    )


def correctness_status(baseline_errors: Column, candidate_errors: Column) -> Column:
    """From the error counts of both benchmarks."""
    return (
        F.when(baseline_errors.isNull() | candidate_errors.isNull(), "unavailable")
        .when((baseline_errors > 0) | (candidate_errors > 0), "failed")
        .otherwise("passed")
    )


def run_correctness(baseline: Column, candidate: Column) -> Column:
    """From the correctness states of both runs."""
    return (
        F.when((baseline == "failed") | (candidate == "failed"), "failed")
        .when((baseline == "passed") & (candidate == "passed"), "passed")
        .otherwise("unavailable")
    )


def _conclusion(comparable: Column, regressed: Column, improved: Column, verified: Column) -> Column:
    return (
        F.when(~comparable, "not_comparable")
        .when(regressed, "candidate_regression")
        .when(improved & verified, "verified_improvement")
        .when(improved, "candidate_improvement")
        .otherwise("no_material_change")
    )


def ab_verdict(pairs: DataFrame) -> DataFrame:
    """Matched A/B conclusion.

    Columns: ``environment_match, profiles_comparable, benchmarks_comparable, containerized,
    treatment_changed, correctness_status, resource_status, baseline_quality, candidate_quality,
    improved_metrics, regressed_metrics``.
    """
    comparable = (
        F.col("environment_match")
        & F.col("profiles_comparable")
        & F.col("benchmarks_comparable")
        & F.col("containerized")
    )
    return pairs.withColumn("comparable", comparable).withColumn(
        "conclusion",
        _conclusion(
            F.col("comparable"),
            F.size("regressed_metrics") > 0,
            F.size("improved_metrics") > 0,
            _verified(),
        ),
    )


def _verified() -> Column:
    return (
        F.col("treatment_changed")
        & (F.col("correctness_status") == "passed")
        & (F.col("resource_status") == "no_observed_regression")
        & (F.col("baseline_quality") == "verified")
        & (F.col("candidate_quality") == "verified")
    )


def optimization_verdict(pairs: DataFrame) -> DataFrame:
    """Conclusion of one optimization round.

    As ``ab_verdict``, but image and workload may differ (``fixed_environment_match`` covers the
    rest), both analyses must be verified, the event sources must match, and a selected
    runtime-lock comparison gates the result: ``lock_selected, lock_comparable, lock_conclusion,
    lock_baseline_quality, lock_candidate_quality`` (nulls where there is none).
    """
    selected, lock_comparable = F.col("lock_selected"), F.coalesce("lock_comparable", F.lit(False))
    lock_conclusion = F.coalesce(F.col("lock_conclusion"), F.lit(""))
    lock_status = (
        F.when(~selected, "not_selected")
        .when(F.col("lock_comparable").isNull(), "unavailable")
        .when(
            (F.col("lock_baseline_quality") == "complete")
            & (F.col("lock_candidate_quality") == "complete")
            & lock_comparable,
            "complete",
        )
        .otherwise("partial")
    )
    comparable = (
        F.col("fixed_environment_match")
        & F.col("profiles_comparable")
        & F.col("benchmarks_comparable")
        & F.col("containerized")
        & F.col("event_source_match")
        & (~selected | lock_comparable)
    )
    verified = (
        _verified()
        & F.col("analyses_verified")
        & F.col("runtime_lock_status").isin("not_selected", "complete")
        & ~lock_conclusion.isin("candidate_regression", "not_comparable")
    )
    return (
        pairs.withColumn("runtime_lock_status", lock_status)
        .withColumn("comparable", comparable)
        .withColumn(
            "conclusion",
            _conclusion(
                F.col("comparable"),
                (lock_conclusion == "candidate_regression") | (F.size("regressed_metrics") > 0),
                F.size("improved_metrics") > 0,
                verified,
            ),
        )
    )


def material_change_percent(before: Column, after: Column) -> Column:
    """Signed change in percent; from nothing to something is 100."""
    b, a = before.cast("double"), after.cast("double")
    return F.when(b == a, 0.0).when(b == 0, 100.0).otherwise((a - b) / F.nullif(b, F.lit(0.0)) * 100.0)


# fixed values: the totals that may be compared under each measurement semantics
_LOCK_METRICS = {
    "exact": ("total_exact_hold_ns", "total_exact_wait_ns"),
    "thresholded": ("total_thresholded_wait_ns",),
}


def runtime_lock_metrics(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The comparable totals of each analysis in long form: ``metric, value``.

    ``totals`` carries ``semantics`` and the five totals.  Sampled and cumulative runs compare wait
    time where there is any, else their observation count.
    """
    semantics, wait = F.col("semantics"), F.col("total_observed_or_estimated_wait_ns")

    def pick(condition: Column, name: str) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")))

    choices = [pick(semantics == kind, name) for kind, names in _LOCK_METRICS.items() for name in names]
    choices += [
        pick(semantics.isin("sampled", "cumulative") & (wait != 0), "total_observed_or_estimated_wait_ns"),
        pick((semantics == "sampled") & (wait == 0), "total_sampled_observation_count"),
        pick((semantics == "cumulative") & (wait == 0), "total_cumulative_observation_count"),
    ]
    return (
        totals.select(*keys, F.explode(F.array_compact(F.array(*choices))).alias("m"))
        .select(*keys, "m.metric", "m.value")
    )


def runtime_lock_changes(before: DataFrame, after: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Change of each comparable total and whether it is material."""
    left = before.select(*pair, "metric", F.col("value").alias("baseline_value"))
    right = after.select(*pair, "metric", F.col("value").alias("candidate_value"))
    change = material_change_percent(F.col("baseline_value"), F.col("candidate_value"))
    return left.join(right, [*pair, "metric"]).withColumn("change_percent", change).withColumn(
        "status",
        F.when(F.col("change_percent") <= -MIN_MATERIAL_PERCENT, "candidate_improvement")
        .when(F.col("change_percent") >= MIN_MATERIAL_PERCENT, "candidate_regression")
        .otherwise("no_material_change"),
    )


# fixed values: what must agree before two runtime-lock runs are compared
LOCK_MATCHES = (
    "adapter_match",
    "semantics_match",
    "threshold_or_sampling_match",
    "workload_match",
    "resource_environment_match",
)


def runtime_lock_verdict(pairs: DataFrame) -> DataFrame:
    """Runtime-lock A/B conclusion and its conclusion gates.

    Columns: the ``LOCK_MATCHES``, ``correctness_status, replay_passed, treatment_changed`` (null
    outside container rounds), ``resource_status, improved_metrics, regressed_metrics,
    baseline_allowed, candidate_allowed, baseline_forbidden, candidate_forbidden``.
    """
    comparable = (F.col("correctness_status") == "passed") & F.col("replay_passed")
    for name in LOCK_MATCHES:
        comparable = comparable & F.col(name)
    comparable = comparable & F.coalesce("treatment_changed", F.lit(True))
    none = F.array().cast("array<string>")
    regressed = F.when(
        F.col("resource_status") == "regression",
        F.sort_array(F.array_append("regressed_metrics", F.lit("resource_transfer"))),
    ).otherwise(F.col("regressed_metrics"))
    rows = (
        pairs.withColumn("comparable", comparable)
        .withColumn("improved_metrics", F.when(F.col("comparable"), F.col("improved_metrics")).otherwise(none))
        .withColumn("regressed_metrics", F.when(F.col("comparable"), regressed).otherwise(none))
    )
    allowed, forbidden = conclusion_gates(
        F.array_append(F.array_intersect("baseline_allowed", "candidate_allowed"), F.lit("runtime_lock_comparison")),
        F.concat(
            F.array_union("baseline_forbidden", "candidate_forbidden"),
            F.array(F.lit("performance_root_cause"), F.lit("verified_improvement")),
        ),
    )
    return (
        rows.withColumn("allowed_conclusions", allowed)
        .withColumn("forbidden_conclusions", forbidden)
        .withColumn(
            "conclusion",
            _conclusion(
                F.col("comparable"),
                F.size("regressed_metrics") > 0,
                F.size("improved_metrics") > 0,
                F.lit(False),
            ),
        )
    )


def conclusion_gates(allowed: Column, forbidden: Column) -> tuple[Column, Column]:
    """Sorted gate sets; what is forbidden is never allowed."""
    forbidden = F.sort_array(F.array_distinct(forbidden))
    return F.sort_array(F.array_except(F.array_distinct(allowed), forbidden)), forbidden
