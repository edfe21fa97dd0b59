"""Pairing over micro-batches with the batch operators themselves: no row is looked at in Python.

Each micro-batch is one job for ``foreachBatch``.  Rows wait until the watermark (the latest time seen, less a
delay) has passed them; the rows that are due go through the batch operator of their kind together with one
``carry`` row per key, which holds what earlier rows left open.  Keys that a batch does not touch stay as they
are, and a key of any size is scanned in spans like in the batch.  So the results are those of the batch
operator over all rows that came in time, however the rows were dealt to the batches.

State and results are Parquet tables, one folder per batch.  A batch that is run again reads the state of the
batch before it and overwrites its own folders, so results hold every row once.  The state of a batch is as
large as the number of open keys plus the rows not yet due.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import locks as L
from gristmill.operators import sched as S

HOUR_NS = 3_600_000_000_000


@dataclass(frozen=True)
class Pairing:
    """A kind of pairing: its keys, its batch operator, what that leaves open, and its results."""

    keys: tuple[str, ...]
    steps: Callable[..., DataFrame]
    carried: Callable[[DataFrame], DataFrame]
    results: dict[str, Callable[[DataFrame], DataFrame]]


def _migrations(steps: DataFrame) -> DataFrame:
    return steps.where(S.migrated()).select("capture_id", "tid", "event_index", "event_id", "event_type", "cpu", "run_cpu")


THREADS = Pairing(
    keys=tuple(S.THREAD),
    steps=S.transitions,
    carried=S.carried,
    results={"runs": S.runtime_intervals, "latencies": S.runnable_latencies, "off_cpu": S.off_cpu_intervals, "migrations": _migrations},
)
LOCKS = Pairing(
    keys=tuple(L.SUBJECT),
    steps=L.lock_steps,
    carried=L.carried,
    results={"waits": L.wait_intervals, "holds": L.hold_intervals, "issues": L.pairing_issues},
)


class CarriedPairing:
    """Pairs the rows of a stream; use ``step`` as the function of ``foreachBatch``.

    ``folder`` is in a store that all machines share and belongs to one stream and its checkpoint.  ``delay_ns`` is
    how much later than the newest row a row may come; ``silence_ns`` how long a key may be silent before what it
    left open is reported as ended.  ``schema`` is that of the rows (``capture_id, tid, event_index, event_id,
    ts_ns, event_type`` and what the batch operator reads); ``event_index`` must order the rows of a key as their
    times do.  ``wanted`` names the results that are written (all if it is missing); late rows always are.
    """

    def __init__(
        self, spark: SparkSession, folder: str, kind: Pairing, schema, delay_ns: int, silence_ns: int = HOUR_NS, wanted: Iterable[str] | None = None
    ):
        self.spark, self.folder, self.kind, self.schema = spark, folder.rstrip("/"), kind, schema
        self.delay_ns, self.silence_ns = delay_ns, silence_ns
        self.results = kind.results if wanted is None else {name: kind.results[name] for name in wanted}

    # --- tables

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch:012d}"

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _drop(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _load(self, table: str, batch: int) -> DataFrame | None:
        path = self._path(table, batch)
        return self.spark.read.parquet(path) if self._exists(f"{path}/_SUCCESS") else None

    def _save(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        path = self._path(table, batch)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _watermark(self, batch: int) -> int | None:
        known = self._load("watermark", batch)
        return None if known is None else known.first()["watermark_ns"]

    def result(self, name: str) -> DataFrame:
        """All rows of a result (or ``late``) so far."""
        return self.spark.read.parquet(f"{self.folder}/{name}")

    # --- one batch

    def step(self, rows: DataFrame, batch: int) -> None:
        """Take in a micro-batch."""
        self._advance(rows, batch, close=False)

    def finish(self, batch: int) -> None:
        """Take all waiting rows and close all keys, as if the stream had ended; ``batch`` is the number after the last."""
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self._advance(self.spark.range(0).select(*none), batch, close=True)

    def _advance(self, rows: DataFrame, batch: int, close: bool) -> None:
        keys = list(self.kind.keys)
        before = self._watermark(batch - 1)
        columns = [f.name for f in self.schema.fields]
        rows = rows.select(*columns)
        passed = F.lit(False) if before is None else F.col("ts_ns") <= before
        # a batch is read once: what it brings is split into late and waiting rows
        taken = self._save(rows.withColumn("late", passed), "taken", batch)
        self._save(taken.where("late").drop("late"), "late", batch)
        waiting = taken.where("not late").drop("late")
        old = self._load("waiting", batch - 1)
        if old is not None:
            waiting = waiting.unionByName(old)
        newest = waiting.agg(F.max("ts_ns")).first()[0]
        watermark = max([x for x in (before, None if newest is None else newest - self.delay_ns) if x is not None], default=-(1 << 62))
        due = F.lit(True) if close else F.col("ts_ns") <= watermark
        ready = self._save(waiting.where(due), "ready", batch)
        self._save(waiting.where(~due), "waiting", batch)

        carry = self._load("carry", batch - 1)
        touched = ready.select(*keys).distinct()
        silent = F.lit(True) if close else F.col("last_ns") + self.silence_ns < watermark
        last = ready.groupBy(*keys).agg(F.max("ts_ns").alias("last_ns"))
        if carry is None:
            open_keys, resting = None, None
        else:
            met = carry.join(touched.withColumn("touched", F.lit(True)), keys, "left")
            # silent keys without new rows are ended in this batch; all others rest
            resting = met.where(F.col("touched").isNull() & ~silent).drop("touched")
            open_keys = met.where(F.col("touched").isNotNull() | silent).drop("touched")
        earlier = None if open_keys is None else open_keys.drop("last_ns")
        steps = self._save(self.kind.steps(ready, earlier), "steps", batch)
        # what a key leaves open goes on, unless the key is ended here
        now = self.kind.carried(steps).join(last, keys, "left")
        if open_keys is not None:
            now = now.join(open_keys.select(*keys, F.col("last_ns").alias("__before")), keys, "left")
            now = now.withColumn("last_ns", F.coalesce("last_ns", "__before")).drop("__before")
        kept = now.where(~silent)
        # end rows stand for the end of the stream only where a key is ended
        ended = now.where(silent).select(*keys, F.lit(True).alias("__ended"))
        final = steps.join(ended, keys, "left").where((F.col("event_type") != "end") | F.col("__ended")).drop("__ended")
        for name, rows_of in self.results.items():
            self._save(rows_of(final), name, batch)
        self._save(kept if resting is None else kept.unionByName(resting.select(*kept.columns)), "carry", batch)
        self._save(self.spark.range(1).select(F.lit(watermark).cast("long").alias("watermark_ns")), "watermark", batch)
        for table in ("taken", "ready", "steps"):
            self._drop(self._path(table, batch))
        for table in ("waiting", "carry", "watermark"):  # the batch before is kept, in case this one is run again
            self._drop(self._path(table, batch - 2))
