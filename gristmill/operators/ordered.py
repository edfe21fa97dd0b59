"""Running values over long ordered streams, without one task per key.

A plain window puts every row of a key into one task, so one capture (or thread, or lock) that
holds a third of all rows decides the run time.  ``running`` cuts each key's stream into spans of
its order column, computes the running value inside each span, scans the per-span summaries (a
few bytes each) and adds what was carried in.  The result equals the plain window.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows of one key that one task sorts; event_index is dense per capture, so a span can never
# hold more rows than this.
SPAN_ROWS = 1 << 16
_SPAN = "__span"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (``spark.checkpoint.dir``); an error where a cluster names none.

    A session on one machine, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not (context.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go when the result is no longer used.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_texts(df: DataFrame) -> DataFrame:
    """``cut`` for tables with long texts: Parquet with compressed columns in the shared folder, pruned on reading.

    The files lie in ``gristmill-kept`` and may be removed once a result is written.
    """
    path = f"{shared_dir(df.sparkSession)}/gristmill-kept/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_known(rows: DataFrame, other: DataFrame, keys: list[str], known: str) -> DataFrame:
    """Left join on ``keys``; rows whose key ``known`` is null stay out of the shuffle, else one task gets them all."""
    met = rows.where(F.col(known).isNotNull()).join(other, keys, "left")
    return met.unionByName(rows.where(F.col(known).isNull()), allowMissingColumns=True)


@dataclass(frozen=True)
class Running:
    """One running value.

    ``kind``: ``sum`` (0 when empty), ``max``, ``min``, ``last`` (last non-null) or ``since``
    (sum of ``value`` after the last row where ``reset`` is true; that row itself not counted).
    ``inclusive`` says whether the current row takes part.
    """

    kind: str
    value: Column
    inclusive: bool = True
    reset: Column | None = None


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def running_last(value: Column, inclusive: bool = True) -> Running:
    return Running("last", value, inclusive)


def count_since(value: Column, reset: Column, inclusive: bool = True) -> Running:
    return Running("since", value, inclusive, reset)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    specs: dict[str, Running],
    span: int | Column = SPAN_ROWS,
) -> DataFrame:
    """Add the running values in ``specs`` to ``df``.

    ``keys`` are non-null columns; ``order`` is a non-null number, unique within the keys.
    ``span`` is the number of ``order`` units per span, or a column that grows with ``order``.
    All values are computed in the same shuffle.
    """
    span_of = span if isinstance(span, Column) else F.floor(F.col(order) / F.lit(span))
    staged = df.withColumn(_SPAN, span_of)
    inside = Window.partitionBy(*keys, _SPAN).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    spans = Window.partitionBy(*keys).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, -1)
    spans_upto = Window.partitionBy(*keys).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, 0)

    # windows that do not need each other's values stand in one projection: Spark then passes the rows through one
    # window operator for all of them, not through one for each
    since = {name: spec for name, spec in specs.items() if spec.kind == "since"}
    zero = F.lit(0).cast("long")
    local = staged.withColumns({f"__v_{name}": F.coalesce(spec.value.cast("long"), zero) for name, spec in since.items()})
    local = local.withColumns({f"__c_{name}": F.sum(f"__v_{name}").over(upto) for name in since})
    local = local.withColumns({f"__m_{name}": F.when(spec.reset, F.col(f"__c_{name}")) for name, spec in since.items()})
    inner = {}
    for name, spec in specs.items():
        frame = upto if spec.inclusive else before
        if spec.kind == "sum":
            inner[f"__l_{name}"] = F.coalesce(F.sum(spec.value).over(frame), F.lit(0))
        elif spec.kind == "max":
            inner[f"__l_{name}"] = F.max(spec.value).over(frame)
        elif spec.kind == "min":
            inner[f"__l_{name}"] = F.min(spec.value).over(frame)
        elif spec.kind == "last":
            inner[f"__l_{name}"] = F.last(spec.value, ignorenulls=True).over(frame)
        elif spec.kind == "since":
            # running sum inside the span (__c) at the last reset row
            inner[f"__r_{name}"] = F.last(f"__m_{name}", ignorenulls=True).over(frame)
        else:
            raise ValueError(f"unknown running kind {spec.kind!r}")
    local = local.withColumns(inner)
    upto_row = {name: F.col(f"__c_{name}") - (zero if spec.inclusive else F.col(f"__v_{name}")) for name, spec in since.items()}
    local = local.withColumns({f"__l_{name}": c - F.coalesce(F.col(f"__r_{name}"), zero) for name, c in upto_row.items()})

    summary = []
    for name, spec in specs.items():
        if spec.kind == "sum":
            summary.append(F.sum(spec.value).alias(f"__s_{name}"))
        elif spec.kind == "max":
            summary.append(F.max(spec.value).alias(f"__s_{name}"))
        elif spec.kind == "min":
            summary.append(F.min(spec.value).alias(f"__s_{name}"))
        elif spec.kind == "last":
            summary.append(
                F.max_by(spec.value, F.when(spec.value.isNotNull(), F.col(order))).alias(f"__s_{name}")
            )
        else:
            summary.append(F.sum(f"__v_{name}").alias(f"__s_{name}"))
            summary.append(F.max(f"__m_{name}").alias(f"__t_{name}"))
    carried = (local if since else staged).groupBy(*keys, _SPAN).agg(*summary)
    # absolute running sums at span starts; at the last reset before the span
    carried = carried.withColumns({f"__a_{name}": F.sum(f"__s_{name}").over(spans_upto) - F.col(f"__s_{name}") for name in since})
    carried = carried.withColumns({f"__q_{name}": F.col(f"__a_{name}") + F.col(f"__t_{name}") for name in since})
    taken = {}
    for name, spec in specs.items():
        s = F.col(f"__s_{name}")
        if spec.kind == "sum":
            taken[f"__k_{name}"] = F.coalesce(F.sum(s).over(spans), F.lit(0))
        elif spec.kind == "max":
            taken[f"__k_{name}"] = F.max(s).over(spans)
        elif spec.kind == "min":
            taken[f"__k_{name}"] = F.min(s).over(spans)
        elif spec.kind == "last":
            taken[f"__k_{name}"] = F.last(s, ignorenulls=True).over(spans)
        else:
            taken[f"__k_{name}"] = F.col(f"__a_{name}") - F.coalesce(F.last(f"__q_{name}", ignorenulls=True).over(spans), F.lit(0))
    carried = carried.withColumns(taken)
    carried = carried.select(*keys, _SPAN, *[f"__k_{name}" for name in specs])

    joined = local.join(carried, [*keys, _SPAN], "left")
    out = []
    for name, spec in specs.items():
        here, carry = F.col(f"__l_{name}"), F.col(f"__k_{name}")
        if spec.kind == "sum":
            value = here + carry
        elif spec.kind == "max":
            value = F.greatest(here, carry)
        elif spec.kind == "min":
            value = F.least(here, carry)
        elif spec.kind == "last":
            value = F.coalesce(here, carry)
        else:
            value = F.when(F.col(f"__r_{name}").isNotNull(), here).otherwise(here + carry)
        out.append(value.alias(name))
    return joined.select(*[c for c in df.columns if c not in specs], *out)


def dense_index(
    df: DataFrame, keys: list[str], order: list[str], span: Column, name: str = "event_index"
) -> DataFrame:
    """Number the rows of each key 0,1,2,… in ``order``.

    ``span`` is a column that never decreases along ``order`` (a time bucket, a file split); only
    the per-span row counts are scanned over a whole key.
    """
    staged = df.withColumn(_SPAN, span)
    inside = Window.partitionBy(*keys, _SPAN).orderBy(*order)
    spans = Window.partitionBy(*keys).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        staged.groupBy(*keys, _SPAN)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, _SPAN, F.coalesce(F.sum("__n").over(spans), F.lit(0)).alias("__start"))
    )
    numbered = staged.withColumn("__rn", F.row_number().over(inside))
    return (
        numbered.join(starts, [*keys, _SPAN])
        .withColumn(name, (F.col("__start") + F.col("__rn") - 1).cast("long"))
        .drop("__rn", "__start", _SPAN)
    )


def running_within(
    df: DataFrame,
    keys: list[str],
    order: str,
    groups: list[tuple[list[str], dict[str, Running]]],
    known: DataFrame,
    span: int = SPAN_ROWS,
) -> DataFrame:
    """Running values over the stream of ``keys`` and over streams inside it, all in one shuffle.

    Each of ``groups`` names further columns (null there is a stream of its own) and its values (``sum``, ``max``,
    ``min`` or ``last``); one group has none.  What a span takes over from those before it comes as one row per
    stream ahead of the span's own rows.  ``known`` (one row per keys at most) is joined to these few rows, and every
    row gets its columns.
    """
    staged = df.withColumn(_SPAN, F.floor(F.col(order) / F.lit(span)))
    kept = [c for c in known.columns if c not in keys]
    stream = staged.withColumn("__group", F.lit(None).cast("int"))
    for n, (inner, specs) in enumerate(groups):
        summary = []
        for name, spec in specs.items():
            plain = {"sum": F.sum, "max": F.max, "min": F.min}
            value = plain[spec.kind](spec.value) if spec.kind in plain else F.max_by(spec.value, F.when(spec.value.isNotNull(), F.col(order)))
            summary.append(value.alias(f"__s_{name}"))
        spans = Window.partitionBy(*keys, *inner).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, -1)
        fold = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
        carried = staged.groupBy(*keys, *inner, _SPAN).agg(*summary)
        carried = carried.select(
            *keys, *inner, _SPAN, F.lit(n).alias("__group"), *[fold[spec.kind](F.col(f"__s_{name}")).over(spans).alias(f"__k_{name}") for name, spec in specs.items()]
        )
        if inner:
            taken = F.lit(False)
            for name in specs:
                taken = taken | F.col(f"__k_{name}").isNotNull()
            carried = carried.where(taken)
        else:
            carried = carried.join(known, keys, "left")
        stream = stream.unionByName(carried, allowMissingColumns=True)

    # all windows below keep this distribution
    rows = stream.repartition(*keys, _SPAN)
    own = F.col("__group").isNull()
    for n, (inner, specs) in sorted(enumerate(groups), key=lambda g: not g[1][0]):
        inside = Window.partitionBy(*keys, _SPAN, *inner).orderBy(F.col(order).asc_nulls_first())
        values = {}
        for name, spec in specs.items():
            value = F.when(own, spec.value).when(F.col("__group") == n, F.col(f"__k_{name}"))
            # a carried row is ahead of the first own row, so it takes part in either frame
            frame = inside.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
            if spec.kind == "sum":
                values[name] = F.coalesce(F.sum(value).over(frame), F.lit(0).cast("long"))
            else:
                values[name] = {"max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[spec.kind](value).over(frame)
        if not inner:
            values |= {c: F.first(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for c in kept}
        rows = rows.withColumns(values)
    added = [name for _, specs in groups for name in specs]
    return rows.where(own).select(*df.columns, *added, *kept)
