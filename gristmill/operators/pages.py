"""Pages, filters and look-ups over exported rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: the sort keys of runtime-lock projections
HOTSPOT_SORTS = ("self_percent", "inclusive_percent")
LOCK_SORTS = (
    "observed_or_estimated_wait_ns", "exact_wait_count", "thresholded_wait_count",
    "sampled_observation_count", "cumulative_observation_count", "exact_hold_ns", "owner_observed_count",
)


def page(rows: DataFrame, order: Sequence[Column | str], cursor: int = 0, limit: int = 30) -> DataFrame:
    """Rows ``cursor … cursor+limit`` of each capture in ``order``, with total and next cursor."""
    if cursor < 0 or limit < 1:
        raise ValueError("cursor must be non-negative and limit positive")
    w = Window.partitionBy("capture_id").orderBy(*order)
    totals = rows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total_items"))
    picked = (
        rows.withColumn("__row", F.row_number().over(w))
        .where(F.col("__row") <= cursor + limit)  # on the row number itself: a group limit before the shuffle
        .where(F.col("__row") > cursor)
        .withColumn("position", F.col("__row") - 1)
        .drop("__row")
    )
    end = F.lit(cursor + limit)
    return picked.join(totals, "capture_id").withColumn(
        "next_cursor", F.when(end < F.col("total_items"), end)
    )


def hotspot_page(
    spots: DataFrame,
    sort_by: str = "self_percent",
    cursor: int = 0,
    limit: int = 30,
    classifications: DataFrame | None = None,
    category: str | None = None,
) -> DataFrame:
    """A page of hotspots, optionally only those classified under ``category``."""
    if sort_by not in HOTSPOT_SORTS:
        raise ValueError(f"unknown sort key {sort_by!r}")
    rows = spots
    if category is not None:
        wanted = classifications.where(F.col("category") == category).select("capture_id", "hotspot_id")
        rows = rows.join(wanted, ["capture_id", "hotspot_id"], "left_semi")
    return page(rows, [F.desc(sort_by), "symbol", "dso"], cursor, limit)


def call_path_page(paths: DataFrame, symbol: str | None = None, cursor: int = 0, limit: int = 20) -> DataFrame:
    """A page of call paths, optionally only those containing ``symbol``."""
    rows = paths if symbol is None else paths.where(F.exists("path", lambda f: f["symbol"] == symbol))
    return page(rows, ["rank"], cursor, limit)


def lock_page(
    projection: DataFrame, identity: Sequence[str], sort_by: str = LOCK_SORTS[0], cursor: int = 0, limit: int = 30
) -> DataFrame:
    """A page of a runtime-lock projection under one of seven sort keys; ties by identity."""
    if sort_by not in LOCK_SORTS:
        raise ValueError(f"unknown sort key {sort_by!r}")
    return page(projection, [F.desc(sort_by), *identity], cursor, limit)


def hotspot_paths(spots: DataFrame, paths: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` heaviest exported call paths through each exported hotspot."""
    members = paths.select(
        "capture_id", "path_id", F.col("rank").alias("path_rank"), F.col("weight").alias("path_weight"),
        F.explode(F.array_distinct("path")).alias("f"),
    ).select("capture_id", "path_id", "path_rank", "path_weight", "f.symbol", "f.dso")
    w = Window.partitionBy("capture_id", "symbol", "dso").orderBy("path_rank")
    top = members.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
    return spots.select("capture_id", "hotspot_id", "symbol", "dso").join(top, ["capture_id", "symbol", "dso"])


def with_stack_frames(rows: DataFrame, stacks: DataFrame) -> DataFrame:
    """Add the frames of ``stack_id``; rows without a stack stay."""
    return rows.join(stacks.select("capture_id", "stack_id", "frames"), ["capture_id", "stack_id"], "left")


def canonical_order(events: DataFrame) -> DataFrame:
    """Events by capture in (time, cpu, sequence, id) order, ready to be written.

    Range partitions split a big capture; each output partition is sorted.
    """
    order = ["capture_id", "ts_ns", "cpu", "event_index", "event_id"]
    return events.repartitionByRange(*order).sortWithinPartitions(*order)
