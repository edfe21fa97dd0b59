"""Benchmark JSON in four dialects, normalized to one value table and one environment row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.ordered import cut_texts
from gristmill.sources.lines import capture_of, once

# fixed values: schemas of the fields that are read, and the metric names and units they become
HYPERFINE = "struct<results: array<struct<command: string, times: array<double>, exit_codes: array<int>>>>"
PYPERF = (
    "struct<metadata: struct<cpu_model_name: string, cpu_count: int, cpu_affinity: string>,"
    " benchmarks: array<struct<name: string, metadata: struct<name: string, unit: string>,"
    " runs: array<struct<values: array<double>>>>>>"
)
GOOGLE = (
    "struct<context: struct<num_cpus: int, cpu_info: string, library_build_type: string>,"
    " benchmarks: array<struct<name: string, run_name: string, run_type: string, real_time: double,"
    " cpu_time: double, time_unit: string, items_per_second: double, error_occurred: boolean>>>"
)
NATIVE = (
    "struct<name: string, build_type: string, duration_seconds: double, warmup_seconds: double,"
    " concurrency: int, payload_bytes: bigint, operations: bigint, error_count: int,"
    " environment: map<string, string>,"
    " metrics: map<string, struct<unit: string, higher_is_better: boolean, `values`: array<double>>>>"
)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(capture_id, document): one benchmark file per row."""
    return spark.read.text(path, wholetext=True).select(
        capture_of(F.col("_metadata.file_path"), path).alias("capture_id"), F.col("value").alias("document")
    )


def with_dialect(documents: DataFrame) -> DataFrame:
    """Documents with their ``dialect``: which of the four forms they have, null for none of them.

    It is found once and kept with the documents, so that what reads one form passes over the others.
    """
    if "dialect" in documents.columns:
        return documents
    keyed = once(documents, __keys=F.json_object_keys("document"))

    def has(*names: str) -> Column:
        hit = F.lit(True)
        for name in names:
            hit = hit & F.array_contains("__keys", name)
        return hit

    form = (
        F.when(has("benchmark_id", "schema_version") & (F.get_json_object("document", "$.schema_version") == "1.0"), "native")
        .when(has("results"), "hyperfine")
        .when(has("benchmarks", "context"), "google_benchmark")
        .when(has("benchmarks", "version"), "pyperf")
    )
    return cut_texts(keyed.withColumn("dialect", form).drop("__keys"))


def _values(documents: DataFrame, entry: Column, name: Column, metrics: list[tuple[str, Column, Column, bool]]) -> DataFrame:
    """Explode ``entry`` and turn its metric arrays into rows."""
    rows = documents.select("capture_id", F.posexplode(entry).alias("entry_no", "e")).withColumn("name", name)
    structs = [
        F.struct(
            F.lit(metric).alias("metric"),
            unit.alias("unit"),
            F.lit(higher).alias("higher_is_better"),
            values.alias("values"),
        )
        for metric, unit, values, higher in metrics
    ]
    return (
        rows.select("capture_id", "name", "entry_no", F.explode(F.array(*structs)).alias("m"))
        .select("capture_id", "name", "entry_no", "m.metric", "m.unit", "m.higher_is_better", F.posexplode("m.values").alias("value_no", "value"))
        .where(F.col("value").isNotNull())
    )


def benchmark_values(documents: DataFrame) -> DataFrame:
    """Long form ``capture_id, name, metric, unit, higher_is_better, entry_no, value_no, value``.

    A file may hold several names; choose one with a filter.  Optional metrics count only when
    every entry of the name reports them.
    """
    marked = with_dialect(documents)

    def of(kind: str, schema: str) -> DataFrame:
        return marked.where(F.col("dialect") == kind).withColumn("d", F.from_json("document", schema))

    e = F.col("e")
    hyperfine = _values(
        of("hyperfine", HYPERFINE),
        F.col("d.results"),
        F.coalesce(e["command"], F.lit("unknown")),
        [("wall_time", F.lit("seconds"), e["times"], False)],
    )
    pyperf = _values(
        of("pyperf", PYPERF),
        F.col("d.benchmarks"),
        F.coalesce(F.nullif(e["metadata"]["name"], F.lit("")), F.nullif(e["name"], F.lit("")), F.lit("unknown")),
        [
            (
                "value",
                F.coalesce(F.nullif(e["metadata"]["unit"], F.lit("")), F.lit("seconds")),
                F.flatten(F.transform(e["runs"], lambda r: r["values"])),
                False,
            )
        ],
    )
    unit = F.coalesce(e["time_unit"], F.lit("nanoseconds"))
    google = _values(
        of("google_benchmark", GOOGLE),
        F.filter("d.benchmarks", lambda b: F.coalesce(b["run_type"], F.lit("iteration")) == "iteration"),
        F.coalesce(F.nullif(e["run_name"], F.lit("")), F.nullif(e["name"], F.lit("")), F.lit("unknown")),
        [
            ("real_time", unit, F.array(e["real_time"]), False),
            ("cpu_time", unit, F.array(e["cpu_time"]), False),
            ("items_per_second", F.lit("items/second"), F.array(e["items_per_second"]), True),
        ],
    )
    counts = google.groupBy("capture_id", "name", "metric").agg(F.count(F.lit(1)).alias("__n"))
    needed = counts.where(F.col("metric") == "real_time").select("capture_id", "name", F.col("__n").alias("__need"))
    complete = counts.join(needed, ["capture_id", "name"]).where("__n = __need").select("capture_id", "name", "metric")
    google = google.join(complete, ["capture_id", "name", "metric"], "left_semi").select(hyperfine.columns)
    native = (
        of("native", NATIVE)
        .select("capture_id", F.col("d.name").alias("name"), F.explode(F.map_entries("d.metrics")).alias("m"))
        .select(
            "capture_id",
            "name",
            F.lit(0).alias("entry_no"),
            F.col("m.key").alias("metric"),
            F.col("m.value.unit").alias("unit"),
            F.col("m.value.higher_is_better").alias("higher_is_better"),
            F.posexplode("m.value.values").alias("value_no", "value"),
        )
    )
    return hyperfine.unionByName(pyperf).unionByName(google).unionByName(native)


def benchmark_runs(documents: DataFrame) -> DataFrame:
    """One row per (capture, name): dialect, error count and the condition fields as a map."""
    marked = with_dialect(documents)

    def of(kind: str, schema: str) -> DataFrame:
        return marked.where(F.col("dialect") == kind).withColumn("d", F.from_json("document", schema))

    def fields(**columns: Column) -> Column:
        pairs = [x for name, c in columns.items() for x in (F.lit(name.replace("__", ".")), c.cast("string"))]
        return F.map_filter(F.create_map(*pairs), lambda _k, v: v.isNotNull())

    hyper = of("hyperfine", HYPERFINE).select("capture_id", "dialect", F.explode("d.results").alias("e")).select(
        "capture_id",
        "dialect",
        F.coalesce("e.command", F.lit("unknown")).alias("name"),
        F.size(F.filter(F.coalesce("e.exit_codes", F.array().cast("array<int>")), lambda c: c != 0)).alias("error_count"),
        F.create_map().cast("map<string,string>").alias("fields"),
    )
    d = F.col("d")
    py = of("pyperf", PYPERF).select("capture_id", "dialect", "d", F.explode("d.benchmarks").alias("e")).select(
        "capture_id",
        "dialect",
        F.coalesce(F.nullif("e.metadata.name", F.lit("")), F.nullif("e.name", F.lit("")), F.lit("unknown")).alias("name"),
        F.lit(None).cast("int").alias("error_count"),
        fields(
            environment__cpu_model=d["metadata"]["cpu_model_name"],
            environment__cpu_count=d["metadata"]["cpu_count"],
            environment__cpu_affinity=d["metadata"]["cpu_affinity"],
        ).alias("fields"),
    )
    google = (
        of("google_benchmark", GOOGLE)
        .select("capture_id", "dialect", "d", F.explode("d.benchmarks").alias("e"))
        .where(F.coalesce("e.run_type", F.lit("iteration")) == "iteration")
        .groupBy(
            "capture_id",
            "dialect",
            F.coalesce(F.nullif("e.run_name", F.lit("")), F.nullif("e.name", F.lit("")), F.lit("unknown")).alias("name"),
        )
        .agg(
            F.count_if(F.coalesce("e.error_occurred", F.lit(False))).cast("int").alias("error_count"),
            F.first(
                fields(
                    build_type=d["context"]["library_build_type"],
                    environment__cpu_count=d["context"]["num_cpus"],
                    environment__cpu_model=d["context"]["cpu_info"],
                )
            ).alias("fields"),
        )
    )
    native = of("native", NATIVE).select(
        "capture_id",
        "dialect",
        F.col("d.name").alias("name"),
        F.col("d.error_count").alias("error_count"),
        F.map_concat(
            fields(
                name=d["name"],
                build_type=d["build_type"],
                duration_seconds=d["duration_seconds"],
                warmup_seconds=d["warmup_seconds"],
                concurrency=d["concurrency"],
                payload_bytes=d["payload_bytes"],
                operations=d["operations"],
            ),
            F.transform_keys(
                F.coalesce("d.environment", F.create_map().cast("map<string,string>")),
                lambda k, _v: F.concat(F.lit("environment."), k),
            ),
        ).alias("fields"),
    )
    return hyper.unionByName(py).unionByName(google).unionByName(native)
