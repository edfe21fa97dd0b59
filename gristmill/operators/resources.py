"""Resource deltas over an observation window, and what they say about a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: counters that must not fall, limits that should not change, in check order
COUNTERS = (
    "cpu_usage_usec", "cpu_user_usec", "cpu_system_usec", "cpu_nr_periods", "cpu_nr_throttled",
    "cpu_throttled_usec", "memory_pressure_some_usec", "memory_pressure_full_usec",
    "io_pressure_some_usec", "io_pressure_full_usec",
)
IO_FIELDS = ("read_bytes", "write_bytes", "read_ios", "write_ios")
LIMITS = {
    "cpu_quota": ("cpu_quota_usec", "cpu_period_usec"),
    "cpuset": ("cpuset_cpus_effective",),
    "memory_limit": ("memory_max_bytes",),
    "io_limits": ("io_limits",),
    "pids_limit": ("pids_max",),
}
TRANSFER_FIELDS = (
    "cpu_usage_usec", "cpu_nr_throttled", "cpu_throttled_usec", "io_read_bytes", "io_write_bytes",
    "io_read_ios", "io_write_ios", "memory_pressure_some_usec", "memory_pressure_full_usec",
    "io_pressure_some_usec", "io_pressure_full_usec",
)


def first_and_last(snapshots: DataFrame) -> DataFrame:
    """The earliest and latest snapshot of each capture as structs; a partial aggregate, no sort."""
    rest = [c for c in snapshots.columns if c != "capture_id"]
    row = F.struct(*rest)
    order = F.struct(*[c for c in ("ts_ns", "event_id") if c in rest])
    return snapshots.groupBy("capture_id").agg(
        F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"), F.count(F.lit(1)).alias("snapshots")
    )


def io_total(first: Column, last: Column, field: str) -> Column:
    """Growth of one device counter over all devices; a device missing on one side counts 0 there."""

    def by_device(devices: Column) -> Column:
        return F.map_from_entries(
            F.transform(
                F.coalesce(devices, F.array()),
                lambda d: F.struct(F.concat_ws(":", d["major"], d["minor"]), d[field]),
            )
        )

    growth = F.map_zip_with(
        by_device(first), by_device(last), lambda _k, a, b: F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0))
    )
    return F.aggregate(F.map_values(growth), F.lit(0).cast("long"), lambda acc, v: acc + v)


def event_deltas(first: Column, last: Column) -> Column:
    none = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(
        F.coalesce(first, none),
        F.coalesce(last, none),
        lambda _k, a, b: F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0)),
    )


def resource_delta(snapshots: DataFrame) -> DataFrame:
    """One row per capture: counter growth, ``negative_counters`` and ``changed_limits``.

    A counter that falls makes the window invalid (``valid`` false); a changed limit is only noted.
    Columns a snapshot lacks are skipped.
    """
    rows = first_and_last(snapshots)
    have = set(snapshots.columns)
    first, last = F.col("first"), F.col("last")
    deltas = {c: last[c] - first[c] for c in COUNTERS if c in have}
    if "io_devices" in have:
        deltas |= {f"io_{f}": io_total(first["io_devices"], last["io_devices"], f) for f in IO_FIELDS}
    negative = [F.when(d < 0, F.lit(name)) for name, d in deltas.items()]
    changed = []
    for name, columns in LIMITS.items():
        present = [c for c in columns if c in have]
        if present:
            same = F.lit(True)
            for c in present:
                same = same & first[c].eqNullSafe(last[c])
            changed.append(F.when(~same, F.lit(name)))
    none = F.array().cast("array<string>")
    out = [F.col("capture_id"), F.col("snapshots"), (last["ts_ns"] - first["ts_ns"]).alias("window_ns")]
    out += [d.alias(name) for name, d in deltas.items()]
    if "memory_events" in have:
        out.append(event_deltas(first["memory_events"], last["memory_events"]).alias("memory_event_deltas"))
    fallen = F.array_compact(F.array(*negative)) if negative else none
    if "memory_events" in have:
        fallen = F.concat(
            fallen,
            F.map_keys(
                F.map_filter(event_deltas(first["memory_events"], last["memory_events"]), lambda _k, v: v < 0)
            ),
        )
    out.append(fallen.alias("negative_counters"))
    out.append((F.array_compact(F.array(*changed)) if changed else none).alias("changed_limits"))
    return rows.select(*out).withColumn(
        "valid", (F.size("negative_counters") == 0) & (F.col("window_ns") > 0)
    )


def transfer_status(before: DataFrame, after: DataFrame, pair: list[str]) -> DataFrame:
    """Whether the candidate used more of any resource, one row per pair.

    The fields are checked in order: the first missing one makes the pair ``incomplete``, the first
    that grew a ``regression``.  Missing columns count as missing values.  ``quality_status`` of
    both sides must be ``verified``.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        columns = [
            (F.col(f) if f in rows.columns else F.lit(None).cast("bigint")).alias(f"{name}_{f}")
            for f in TRANSFER_FIELDS
        ]
        events = (
            F.col("memory_event_deltas")
            if "memory_event_deltas" in rows.columns
            else F.create_map().cast("map<string,bigint>")
        )
        quality = F.col("quality_status") if "quality_status" in rows.columns else F.lit("verified")
        return rows.select(*pair, *columns, events.alias(f"{name}_events"), quality.alias(f"{name}_quality"))

    joined = side(before, "baseline").join(side(after, "candidate"), pair)
    status = F.when(
        (F.col("baseline_quality") != "verified") | (F.col("candidate_quality") != "verified"), "incomplete"
    )
    for field in TRANSFER_FIELDS:
        b, c = F.col(f"baseline_{field}"), F.col(f"candidate_{field}")
        status = status.when(b.isNull() | c.isNull(), "incomplete").when(c > b, "regression")
    b, c = F.col("baseline_events"), F.col("candidate_events")
    same_names = F.sort_array(F.map_keys(b)) == F.sort_array(F.map_keys(c))
    grew = F.exists(F.map_keys(b), lambda k: F.try_element_at(c, k) > F.try_element_at(b, k))
    status = status.when(~same_names, "incomplete").when(grew, "regression").otherwise("no_observed_regression")
    return joined.select(*pair, status.alias("resource_status"))
