"""Self and inclusive hotspots, call paths and profile totals from stack samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.symbols import percent, source_location, strip_address_offset
from gristmill.operators.ordered import cut, cut_texts, dense_index

KEY = ["capture_id", "symbol", "dso"]


def path_of(frames: str | Column = "frames") -> Column:
    """The (symbol, dso) path of a frame array, root first."""
    return F.transform(frames, lambda f: F.struct(f["symbol"].alias("symbol"), f["dso"].alias("dso")))


def with_path(samples: DataFrame) -> DataFrame:
    """Samples with ``path``; a source that knows it spares the walk over whole frames."""
    return samples if "path" in samples.columns else samples.withColumn("path", path_of())


def hotspots(samples: DataFrame) -> DataFrame:
    """Per (capture, symbol, dso): self, inclusive, sample and occurrence counts, threads.

    A recursive frame counts once into ``inclusive_weight``: the flag "first place of this key in
    its own stack" replaces a grouping by sample, so only partial aggregates are shuffled.
    Frames that lack a symbol or an object are one key without both; each of their places is a first one.
    """
    key, pos = F.col("key"), F.col("pos")
    known = key["symbol"].isNotNull() & key["dso"].isNotNull()
    occurrences = (
        with_path(samples)
        .select("capture_id", "thread_id", "weight", "path", F.size("path").alias("depth"))
        # a key can only come again where a symbol does; the usual stack is not searched for each of its frames
        .withColumn("again", F.size(F.array_distinct(F.col("path.symbol"))) < F.col("depth"))
        .select("capture_id", "thread_id", "weight", "path", "depth", "again", F.posexplode("path").alias("pos", "key"))
        .select(
            "capture_id",
            F.when(known, key["symbol"]).alias("symbol"),
            F.when(known, key["dso"]).alias("dso"),
            "thread_id",
            "weight",
            (pos == F.col("depth") - 1).alias("is_leaf"),
            F.when(F.col("again") & known, F.array_position("path", key) == pos + 1).otherwise(F.lit(True)).alias("is_first"),
        )
    )
    # threads first: the distinct count then adds nothing but a second partial aggregate
    per_thread = occurrences.groupBy(*KEY, "thread_id").agg(
        F.sum(F.when(F.col("is_leaf"), F.col("weight"))).alias("self_weight"),
        F.sum(F.when(F.col("is_first"), F.col("weight"))).alias("inclusive_weight"),
        F.count_if("is_first").alias("sample_count"),
        F.count(F.lit(1)).alias("stack_occurrence_count"),
    )
    return per_thread.groupBy(*KEY).agg(
        F.coalesce(F.sum("self_weight"), F.lit(0)).alias("self_weight"),
        F.sum("inclusive_weight").alias("inclusive_weight"),
        F.sum("sample_count").alias("sample_count"),
        F.sum("stack_occurrence_count").alias("stack_occurrence_count"),
        F.count("thread_id").alias("thread_count"),
    )


def call_paths(samples: DataFrame) -> DataFrame:
    """Weight and record count of each whole (symbol, dso) path.

    Paths are grouped as one text each, a third of the size of their structs; its JSON form tells any two apart.
    """
    text = F.to_json(F.transform("path", lambda f: F.array(f["symbol"], f["dso"])))
    whole = F.transform(F.from_json("__path", "array<array<string>>"), lambda f: F.struct(f[0].alias("symbol"), f[1].alias("dso")))
    return (
        with_path(samples)
        .select("capture_id", text.alias("__path"), "weight")
        .groupBy("capture_id", "__path")
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("record_count"))
        .select("capture_id", whole.alias("path"), "weight", "record_count")
    )


def capture_weight(rows: DataFrame, weight: str) -> DataFrame:
    return rows.groupBy("capture_id").agg(F.sum(weight).alias("total_weight"))


def _weight_span(*weights: str) -> Column:
    """A number that never falls along descending weights; 64 steps per factor of e."""
    span = F.lit(0).cast("bigint")
    for weight in weights:
        span = span * 4096 - F.floor(F.log1p(F.col(weight).cast("double")) * 64)
    return span


def _ranked(rows: DataFrame, order: list, weights: list[str], limit: int | None) -> DataFrame:
    """Add ``rank`` in ``order``: of all rows by spans of the weights, of a top list by a group limit."""
    if limit is None:
        numbered = dense_index(rows, ["capture_id"], order, _weight_span(*weights), "rank")
        return numbered.withColumn("rank", (F.col("rank") + 1).cast("int"))
    top = Window.partitionBy("capture_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= limit)


def export_hotspots(spots: DataFrame, limit: int | None = None, kept: bool = False) -> DataFrame:
    """The hotspots of each capture with rank, id and percents; with ``limit`` the heaviest ones only.

    ``kept`` says that the rows are written already.
    """
    spots = spots if kept else cut(spots)  # ranks, totals and rows are three readings
    order = [F.desc("self_weight"), F.desc("inclusive_weight"), "symbol", "dso"]
    total = F.col("total_weight")
    return (
        _ranked(spots, order, ["self_weight", "inclusive_weight"], limit)
        .join(capture_weight(spots, "self_weight"), "capture_id")
        .withColumn("hotspot_id", F.format_string("H-%03d", "rank"))
        .withColumn("self_percent", percent(F.col("self_weight"), total))
        .withColumn("inclusive_percent", percent(F.col("inclusive_weight"), total))
    )


def export_call_paths(paths: DataFrame, limit: int | None = None, kept: bool = False) -> DataFrame:
    """The call paths of each capture with rank, id and percent; with ``limit`` the heaviest ones only.

    ``kept`` says that the rows are written already.
    """
    paths = paths if kept else cut_texts(paths)
    return (
        _ranked(paths, [F.desc("weight"), "path"], ["weight"], limit)
        .join(capture_weight(paths, "weight"), "capture_id")
        .withColumn("path_id", F.format_string("P-%03d", "rank"))
        .withColumn("percent", percent(F.col("weight"), F.col("total_weight")))
    )


def _values(samples: DataFrame, value, limit: int | None, name: str) -> DataFrame:
    """The distinct values per hotspot, sorted, and whether some were left out.

    With ``limit`` the first in arrival order are kept, which needs ``sample_seq``.
    """
    # only what is needed of a frame is exploded, each different value of a stack once
    narrow = F.array_distinct(
        F.transform("frames", lambda f: F.struct(f["symbol"].alias("symbol"), f["dso"].alias("dso"), value(f).alias("value")))
    )
    if limit is None:
        seen = samples.select("capture_id", F.explode(narrow).alias("frame")).select("capture_id", "frame.*")
        distinct = seen.where(F.col("value").isNotNull()).distinct()
        return distinct.groupBy(*KEY).agg(
            F.sort_array(F.collect_list("value")).alias(name), F.lit(False).alias(f"{name}_truncated")
        )
    seen = (
        samples.select("capture_id", "sample_seq", F.posexplode(narrow).alias("pos", "frame"))
        .select("capture_id", "frame.*", F.struct("sample_seq", "pos").alias("seen"))
        .where(F.col("value").isNotNull())
        .groupBy(*KEY, "value")
        .agg(F.min("seen").alias("seen"))
    )
    arrival = Window.partitionBy(*KEY).orderBy("seen", "value")
    return (
        seen.withColumn("rn", F.row_number().over(arrival))
        .where(F.col("rn") <= limit + 1)  # one more than kept: it only sets the flag
        .groupBy(*KEY)
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("rn") <= limit, F.col("value")))).alias(name),
            (F.max("rn") > limit).alias(f"{name}_truncated"),
        )
    )


def symbol_variants(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw spellings merged into each hotspot; with ``limit`` the first ones seen."""
    rows = _values(
        samples,
        lambda f: strip_address_offset(F.coalesce(F.nullif(f["raw_symbol"], F.lit("")), f["symbol"])),
        limit,
        "symbol_variants",
    )
    cut = F.col("symbol_variants_truncated")
    return rows.withColumn(
        "symbol_variant_count", F.size("symbol_variants") + F.when(cut, 1).otherwise(0)
    ).withColumn("normalization_merged", (F.size("symbol_variants") > 1) | cut)


def source_locations(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Source places of each hotspot; with ``limit`` the first ones seen."""
    return _values(samples, source_location, limit, "source_locations")


def profile_totals(samples: DataFrame) -> DataFrame:
    """One row per capture: weights split by context, by resolution, by call graph and source line."""
    leaf = F.element_at("frames", -1)
    w, context = F.col("weight"), F.col("sample_context")
    unknown = leaf["is_unknown"]
    known_context = context.isin("kernel", "user")

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, w)), F.lit(0)).alias(name)

    multi = F.size("frames") > 1
    scope = ["event", "weight_unit", "weight_source"]
    # by scope first: sums hash, and the few rows per capture are folded afterwards
    parts = samples.groupBy("capture_id", *scope).agg(
        F.sum(w).alias("total_weight"),
        F.count(F.lit(1)).alias("record_count"),
        F.sum(multi.cast("bigint")).alias("__multi"),
        total(multi, "call_graph_weight"),
        total(unknown, "unknown_self_weight"),
        total(context == "kernel", "kernel_context_self_weight"),
        total(context == "user", "user_context_self_weight"),
        total(~known_context, "unknown_context_self_weight"),
        total(unknown & (context == "kernel"), "unresolved_kernel_self_weight"),
        total(unknown & (context == "user"), "unresolved_user_self_weight"),
        total(unknown & ~known_context, "unresolved_unknown_context_self_weight"),
        F.sum(F.size(F.filter("frames", lambda f: f["source_line"].isNotNull()))).alias("source_line_frame_count"),
        total(leaf["source_line"].isNotNull(), "source_line_self_weight"),
        F.sum(F.size(F.filter("frames", lambda f: f["is_inline"]))).alias("inline_frame_count"),
        F.sum(F.size("frames")).alias("total_frame_count"),
    )
    sums = [c for c in parts.columns if c not in ("capture_id", "__multi", *scope)]
    return parts.groupBy("capture_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        (F.sum("__multi") > 0).alias("has_call_graph"),
        *[F.min(c).alias(c) for c in scope],
        (F.count(F.lit(1)) == 1).alias("scope_unique"),
    )


def hotspots_from_paths(paths: DataFrame) -> DataFrame:
    """Self and inclusive weights recomputed from call paths alone."""
    return (
        paths.select("capture_id", "path", "weight", F.posexplode("path").alias("pos", "key"))
        .select(
            "capture_id",
            F.col("key.symbol").alias("symbol"),
            F.col("key.dso").alias("dso"),
            F.when(F.col("pos") == F.size("path") - 1, F.col("weight")).alias("self"),
            F.when(
                F.array_position("path", F.col("key")) == F.col("pos") + 1, F.col("weight")
            ).alias("inclusive"),
        )
        .groupBy(*KEY)
        .agg(
            F.coalesce(F.sum("self"), F.lit(0)).alias("self_weight"),
            F.sum("inclusive").alias("inclusive_weight"),
        )
    )
