"""Token counts through a cache of content digests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.encoding import DEFAULT, encoder, version_digest

CACHE_SCHEMA = "version string, digest string, n_tokens long"


def _encode(tokenizer: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer).count
        for batch in batches:
            counts = [count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    return run


def fill_cache(docs: DataFrame, cache: str, tokenizer: str = DEFAULT) -> None:
    """Encode what ``docs`` (text, digest) holds and the table ``cache`` does not, and append it.

    One row stands for each missing digest: the least id of its group, found by an aggregation that
    sends a group once per task, so a text with a third of all copies is no hot key.  Only then are
    texts shuffled, by (digest, id), and only those rows kept.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(cache)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    missing = docs.groupBy("digest").agg(F.min("row").alias("row")).join(known, "digest", "left_anti")
    texts = docs.select("digest", "row", "text").join(missing, ["digest", "row"], "left_semi")
    fresh = texts.select("digest", "text").mapInArrow(_encode(tokenizer), "digest string, n_tokens long")
    # rows that repeat an id are encoded alike; one of them is stored
    fresh = fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(
    docs: DataFrame, cache: str, tokenizer: str = DEFAULT, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``cache`` is the path of a table (version, digest, n_tokens) that later runs extend; it is made
    when missing.  Counts are stored under the digest of the content and of the tokenizer version, so
    another tokenizer never reads them.  The content is normalised in one way only, null to empty:
    every other normalisation would change counts.

    Null and empty texts have 0 tokens; texts are encoded whole whatever their length; repeated rows
    and ties give one row each; an empty table gives no rows; other columns are ignored.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    digested = docs.select(F.col(key), content.alias("text"), F.sha2(content, 256).alias("digest"))
    row = F.coalesce(F.col(key).cast("string"), F.lit(""))
    fill_cache(digested.select("digest", "text", row.alias("row")), cache, tokenizer)
    counts = (
        docs.sparkSession.read.schema(CACHE_SCHEMA)
        .parquet(cache)
        .where(F.col("version") == version_digest(tokenizer))
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    sizes = digested.select(key, F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(counts, "digest").select(
        key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
