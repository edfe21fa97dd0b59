"""What several operators share: reading tables, the shared folder, batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.ordered import cut, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh table path in the shared folder."""
    return f"{shared_dir(spark)}/gristmill-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``cut`` for larger tables: written as Parquet, so columns are compressed and pruned on reading."""
    return stored(df, new_path(df.sparkSession, name))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder, once all that is made from it is written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place (from 0) in ``order`` over the whole table.

    A range-partitioned sort; a place is that within the partition plus the sizes of those before, so
    only one number per partition is brought together.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__id").bitwiseAND((1 << 33) - 1) + F.col("__before")
    return placed.withColumn("__part", part).join(offsets, "__part").select(*rows.columns, place.alias(name))


def learn_fold(doc_id: str, parts: int, held: int) -> F.Column:
    """True for held-out rows: crc32 of the id as text, modulo ``parts``, equals ``held``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == held, F.lit(False))


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so that what is derived from long texts stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
