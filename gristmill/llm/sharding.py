"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.ordered import dense_index

# Slots are numbered within (shard, part); more parts mean smaller sorts.
SLOT_PARTS = 4096


def _unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) that key and shard decide alone: 48 bits of their MD5 digest."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose ``-weight / ln(unit)`` is highest, so shares follow the weights.

    Every shard's score depends on the key and that shard only: a new shard takes rows into itself
    and moves no other, and a removed one hands out only its own.  A weight of 0 gets no row.  Ties
    go to the smaller shard.  ``key`` is a non-null string column.
    """
    scores = [
        F.struct((F.lit(-float(w)) / F.log(_unit(key, s))).alias("score"), F.lit(-s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    if not scores:
        raise ValueError("at least one shard needs a positive weight")
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return -best["shard"]


def assign_shards(
    rows: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", parts: int = SLOT_PARTS
) -> DataFrame:
    """Key, size, checksum, shard and slot of each row, and its shard when one of weight 1 is added.

    Only these narrow columns are shuffled.  Slots count 0, 1, 2, … in each shard; they are numbered
    in ``parts`` parts by a hash of the key, so no task sorts a whole shard.

    Null texts have size 8 and a null checksum; a null key counts as the empty string; rows that
    repeat a key share its shard and get slots of their own; an empty table gives no rows; other
    columns of ``rows`` are ignored.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = rows.select(
        F.col(key),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.col(text)).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(name, weights).alias("shard"),
        shard_of(name, [*weights, 1.0]).alias("grown_shard"),
    )
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts))
    return dense_index(placed, ["shard"], [key, "text_crc32", "size"], part, "slot")
