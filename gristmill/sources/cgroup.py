"""Container counter files as typed snapshots.

Input: one row per (capture_id, ts_ns) with a map ``files`` from file name to its text, or a
directory tree read by ``read_snapshots``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the files of one snapshot and the limit names of io.max
FILES = (
    "cpu.stat", "cpu.max", "cpuset.cpus.effective", "memory.current", "memory.max", "memory.events",
    "memory.pressure", "io.stat", "io.max", "io.pressure", "pids.current", "pids.max",
)
IO_COUNTERS = {"read_bytes": "rbytes", "write_bytes": "wbytes", "read_ios": "rios", "write_ios": "wios"}
IO_LIMITS = {"read_bps": "rbps", "write_bps": "wbps", "read_iops": "riops", "write_iops": "wiops"}
CPU_COUNTERS = ("usage_usec", "user_usec", "system_usec", "nr_periods", "nr_throttled", "throttled_usec")
_UNSIGNED = r"^[0-9]{1,20}$"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """``path/<capture_id>/<ts_ns>/<file>`` trees as (capture_id, ts_ns, files)."""
    location = F.col("_metadata.file_path")
    part = r"([^/]+)/([0-9]+)/([^/]+)$"
    return (
        spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        .select(
            F.regexp_extract(location, part, 1).alias("capture_id"),
            F.regexp_extract(location, part, 2).cast("bigint").alias("ts_ns"),
            F.regexp_extract(location, part, 3).alias("file"),
            "value",
        )
        .groupBy("capture_id", "ts_ns")
        .agg(F.map_from_entries(F.collect_list(F.struct("file", "value"))).alias("files"))
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unsigned(text: Column) -> Column:
    return F.when(text.rlike(_UNSIGNED), text.try_cast("bigint"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda l: F.trim(l) != "")


def counters(text: Column) -> Column:
    """``name value`` lines as a map; null when a line is malformed or a name repeats."""
    lines = _lines(text)
    good = F.forall(lines, lambda l: F.trim(l).rlike(r"^\S{1,64}\s+[0-9]{1,20}$"))
    names = F.transform(lines, lambda l: F.split(F.trim(l), r"\s+")[0])
    values = F.transform(lines, lambda l: F.split(F.trim(l), r"\s+")[1].try_cast("bigint"))
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return F.when(good & unique & (F.size(lines) > 0), F.map_from_arrays(F.array_distinct(names), values))


def max_scalar(text: Column) -> Column:
    """One number, null for ``max``."""
    value = _strip(text)
    return F.when(value != "max", _unsigned(value))


def pressure(text: Column, kind: str) -> Column:
    """The ``total=`` counter of the ``some`` or ``full`` line."""
    line = F.get(F.filter(_lines(text), lambda l: l.rlike(rf"^{kind}\s")), F.lit(0))
    return _unsigned(F.regexp_extract(line, r"\btotal=([0-9]+)(?:\s|$)", 1))


def _pairs(line: Column) -> Column:
    return F.str_to_map(F.regexp_replace(F.trim(line), r"^\S+\s*", ""), F.lit(" "), F.lit("="))


def io_devices(text: Column) -> Column:
    """``io.stat`` as sorted device structs."""
    devices = F.transform(
        _lines(text),
        lambda l: F.struct(
            F.regexp_extract(F.trim(l), r"^([0-9]+):([0-9]+)", 1).try_cast("bigint").alias("major"),
            F.regexp_extract(F.trim(l), r"^([0-9]+):([0-9]+)", 2).try_cast("bigint").alias("minor"),
            *[_unsigned(F.try_element_at(_pairs(l), F.lit(raw))).alias(name) for name, raw in IO_COUNTERS.items()],
        ),
    )
    return F.array_sort(devices)


def io_limits(text: Column) -> Column:
    """``io.max`` as sorted device structs; a dimension without limit is null, devices without any are left out."""
    limits = F.transform(
        _lines(text),
        lambda l: F.struct(
            F.regexp_extract(F.trim(l), r"^([0-9]+):([0-9]+)", 1).try_cast("bigint").alias("major"),
            F.regexp_extract(F.trim(l), r"^([0-9]+):([0-9]+)", 2).try_cast("bigint").alias("minor"),
            *[_unsigned(F.try_element_at(_pairs(l), F.lit(raw))).alias(name) for name, raw in IO_LIMITS.items()],
        ),
    )
    return F.array_sort(
        F.filter(limits, lambda d: F.coalesce(*[d[name] for name in IO_LIMITS]).isNotNull())
    )


def cpuset_valid(text: Column) -> Column:
    """True for a sorted, disjoint CPU list such as ``0-3,8``."""
    value = _strip(text)
    ranges = F.transform(
        F.split(value, ","),
        lambda r: F.struct(
            F.regexp_extract(r, r"^([0-9]+)", 1).try_cast("int").alias("first"),
            F.regexp_extract(r, r"([0-9]+)$", 1).try_cast("int").alias("last"),
        ),
    )
    ordered = F.aggregate(
        ranges,
        F.struct(F.lit(True).alias("ok"), F.lit(-1).alias("prev")),
        lambda acc, r: F.struct(
            (acc["ok"] & (r["first"] > acc["prev"]) & (r["first"] <= r["last"])).alias("ok"),
            r["last"].alias("prev"),
        ),
    )
    return value.rlike(r"^[0-9]+(?:-[0-9]+)?(?:,[0-9]+(?:-[0-9]+)?)*$") & ordered["ok"]


def parse_snapshots(snapshots: DataFrame) -> DataFrame:
    """Typed snapshot columns from the ``files`` map, and ``invalid`` naming files that did not parse."""
    file = {name: F.try_element_at("files", F.lit(name)) for name in FILES}
    cpu = counters(file["cpu.stat"])
    quota = F.split(_strip(file["cpu.max"]), r"\s+")
    invalid = F.array_compact(
        F.array(
            F.when(F.coalesce(F.try_element_at(cpu, F.lit("usage_usec"))).isNull(), "cpu.stat"),
            F.when(
                (F.size(quota) != 2)
                | ~F.coalesce((F.get(quota, F.lit(0)) == "max") | (_unsigned(F.get(quota, F.lit(0))) > 0), F.lit(False))
                | ~F.coalesce(_unsigned(F.get(quota, F.lit(1))) > 0, F.lit(False)),
                "cpu.max",
            ),
            F.when(~F.coalesce(cpuset_valid(file["cpuset.cpus.effective"]), F.lit(False)), "cpuset.cpus.effective"),
            F.when(file["memory.events"].isNotNull() & counters(file["memory.events"]).isNull(), "memory.events"),
            F.when(
                F.exists(
                    io_devices(F.coalesce(file["io.stat"], F.lit(""))),
                    lambda d: d["major"].isNull() | d["minor"].isNull()
                    | d["read_bytes"].isNull() | d["write_bytes"].isNull() | d["read_ios"].isNull() | d["write_ios"].isNull(),
                ),
                "io.stat",
            ),
        )
    )
    return snapshots.select(
        "capture_id",
        "ts_ns",
        *[F.try_element_at(cpu, F.lit(c)).alias(f"cpu_{c}") for c in CPU_COUNTERS],
        max_scalar(F.get(quota, F.lit(0))).alias("cpu_quota_usec"),
        _unsigned(F.get(quota, F.lit(1))).alias("cpu_period_usec"),
        _strip(file["cpuset.cpus.effective"]).alias("cpuset_cpus_effective"),
        max_scalar(file["memory.current"]).alias("memory_current_bytes"),
        max_scalar(file["memory.max"]).alias("memory_max_bytes"),
        counters(file["memory.events"]).alias("memory_events"),
        pressure(file["memory.pressure"], "some").alias("memory_pressure_some_usec"),
        pressure(file["memory.pressure"], "full").alias("memory_pressure_full_usec"),
        io_devices(F.coalesce(file["io.stat"], F.lit(""))).alias("io_devices"),
        io_limits(F.coalesce(file["io.max"], F.lit(""))).alias("io_limits"),
        pressure(file["io.pressure"], "some").alias("io_pressure_some_usec"),
        pressure(file["io.pressure"], "full").alias("io_pressure_full_usec"),
        max_scalar(file["pids.current"]).alias("pids_current"),
        max_scalar(file["pids.max"]).alias("pids_max"),
        invalid.alias("invalid"),
    )
