"""A store of results that are compared later: tables by capture, bucketed by what they are joined on.

A table is partitioned by ``capture_id``, so one capture is written and read without the others, and bucketed by
its keys, so two captures are joined key by key where they lie: neither side is shuffled, and a capture that
holds most rows is spread over all buckets.  Writing a capture again replaces it alone; columns that come later
are null in what was stored before.  Each table's folder names its keys, columns and buckets, so any session can
open it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class ResultStore:
    """Tables in ``folder``, which all machines share.  ``prefix`` sets the names of its tables apart in the catalog."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, prefix: str = "results"):
        self.spark, self.folder, self.buckets, self.prefix = spark, folder.rstrip("/"), buckets, prefix

    def _table(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _about(self, name: str) -> dict | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_about/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/_about/{name}", wholetext=True).first()[0])

    def _describe(self, name: str, keys: list[str], buckets: int, schema: StructType) -> None:
        about = json.dumps({"keys": keys, "buckets": buckets, "schema": schema.jsonValue()})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/_about/{name}")

    def _open(self, name: str) -> dict | None:
        """What is known of a table; enters it into this session's catalog."""
        about = self._about(name)
        if about is not None and not self.spark.catalog.tableExists(self._table(name)):
            schema = StructType.fromJson(about["schema"])
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            keys = ", ".join(f"`{k}`" for k in about["keys"])
            self.spark.sql(
                f"create table {self._table(name)} ({columns}) using parquet partitioned by (capture_id) "
                f"clustered by ({keys}) sorted by ({keys}) into {about['buckets']} buckets location '{self._path(name)}'"
            )
            self.spark.catalog.recoverPartitions(self._table(name))
        return about

    def write(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Store ``rows``; captures that are stored already are replaced, all others stay.

        ``keys`` are the columns (besides the capture) that the table will be joined on; they are those of the
        first writing.  New columns are added to the table, missing ones are null.
        """
        rest = [c for c in rows.columns if c != "capture_id"]
        rows = rows.select(*rest, "capture_id")
        about = self._open(name)
        if about is None:
            writer = rows.repartition(self.buckets, *keys).write.option("path", self._path(name)).partitionBy("capture_id")
            writer.bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(self._table(name))
            self._describe(name, keys, self.buckets, rows.schema)
            return
        if about["keys"] != list(keys):
            raise ValueError(f"table {name!r} is bucketed by {about['keys']}, not by {list(keys)}")
        table = self.spark.table(self._table(name))
        new = [f for f in rows.schema if f.name not in table.columns]
        if new:
            added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
            self.spark.sql(f"alter table {self._table(name)} add columns ({added})")
            table = self.spark.table(self._table(name))
            self._describe(name, about["keys"], about["buckets"], table.schema)
        empty = self.spark.createDataFrame([], table.schema)
        whole = empty.unionByName(rows, allowMissingColumns=True).select(*table.columns).repartition(about["buckets"], *keys)
        mode = "spark.sql.sources.partitionOverwriteMode"
        old = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")  # an insert into a table does not take it as an option
        try:
            whole.write.mode("overwrite").insertInto(self._table(name))
        finally:
            self.spark.conf.set(mode, old)

    def read(self, name: str, capture=None) -> DataFrame:
        """A stored table, or one capture of it (then without the column ``capture_id``)."""
        if self._open(name) is None:
            raise ValueError(f"no table {name!r} in {self.folder}")
        table = self.spark.table(self._table(name))
        return table if capture is None else table.where(table["capture_id"] == capture).drop("capture_id")

    def forget(self, name: str) -> None:
        """Take a table out of this session's catalog; its files stay."""
        self.spark.sql(f"drop table if exists {self._table(name)}")
