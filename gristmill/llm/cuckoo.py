"""Exact duplicates by an index of cuckoo filters over the digests of live texts.

The index lies in the shared folder.  Digests are dealt to parts; each part has a cuckoo filter, and the
texts stand in a table bucketed by digest.  A digest that its filter does not know belongs to a new text,
which is stored without a look at any other.  A digest that it knows is only a hit: the text is compared
with those under the digest in its bucket (a join that moves neither side), and what equals none of them is
new after all.  Filters take digests out again when the last copy of a text is deleted.  A filter that
overflows is built anew at twice the size from the digests stored beside it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gristmill.llm.common import new_path, removed, stored, written

SLOTS = 4
KICKS = 500
PART_KEYS = 1 << 15  # digests per part that a new index is laid out for
_MIX = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


class CuckooFilter:
    """Fingerprints of 64-bit digests, each in one of two buckets of four slots.

    The second bucket follows from the first and the fingerprint, so entries can be moved and taken out
    without their digest.  Equal digests may stand in it several times, once per stored text.
    """

    def __init__(self, buckets: int, bits: int, slots: np.ndarray | None = None):
        self.buckets, self.bits = buckets, bits
        self.slots = [0] * (buckets * SLOTS) if slots is None else slots.tolist()

    def _places(self, digest: int) -> tuple[int, int]:
        """Fingerprint (never 0, which marks a free slot) and first bucket."""
        mixed = (digest * _MIX) & _WORD
        return (mixed >> 32) % ((1 << self.bits) - 1) + 1, mixed & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (((mark * _MIX) >> 20) & (self.buckets - 1))

    def __contains__(self, digest: int) -> bool:
        mark, b = self._places(digest)
        c = self._other(b, mark)
        return mark in self.slots[b * SLOTS : b * SLOTS + SLOTS] or mark in self.slots[c * SLOTS : c * SLOTS + SLOTS]

    def add(self, digest: int) -> bool:
        """False if no slot could be freed; then one fingerprint is lost and the filter must be built anew."""
        mark, b = self._places(digest)
        for bucket in (b, self._other(b, mark)):
            if self._put(bucket, mark):
                return True
        bucket = self._other(b, mark)
        for kick in range(KICKS):
            place = bucket * SLOTS + (kick * 2654435761 >> 7) % SLOTS
            mark, self.slots[place] = self.slots[place], mark
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def _put(self, bucket: int, mark: int) -> bool:
        for place in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[place]:
                self.slots[place] = mark
                return True
        return False

    def discard(self, digest: int) -> None:
        mark, b = self._places(digest)
        for bucket in (b, self._other(b, mark)):
            for place in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[place] == mark:
                    self.slots[place] = 0
                    return

    def to_bytes(self) -> bytes:
        return np.array(self.slots, dtype="<u4").tobytes()


class _Part:
    """A part's filter and the digests in it, one per stored text."""

    def __init__(self, number: int, bits: int, start: int, marks: bytes | None = None, keys: bytes | None = None):
        self.number, self.bits = number, bits
        slots = np.frombuffer(marks, "<u4") if marks else None
        self.filter = CuckooFilter(start if slots is None else len(slots) // SLOTS, bits, slots)
        self.keys = np.frombuffer(keys, "<i8").tolist() if keys else []

    def add(self, digest: int) -> None:
        self.keys.append(digest)
        if not self.filter.add(digest):
            self._resized()

    def _resized(self) -> None:
        """Twice the buckets, or more, filled from the stored digests.

        A digest in more texts than its two buckets have slots (only digests chosen badly do that) is entered
        as often as they have; then taking one text out leaves it in.
        """
        buckets, once, marks = self.filter.buckets, {}, []
        for key in self.keys:
            once[key] = once.get(key, 0) + 1
            if once[key] <= SLOTS:
                marks.append(key)
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets, self.bits)
            if all(self.filter.add(key) for key in marks):
                return
            if buckets > 64 * (len(marks) + 1):  # too few different fingerprints for these digests
                self.bits, buckets = min(32, self.bits + 4), len(marks)
                buckets = 1 << max(1, buckets.bit_length())

    def drop(self, digests: list[int]) -> None:
        """Take digests out; the filter is built anew where one of them stood more often than it was entered."""
        gone: dict[int, int] = {}
        for d in digests:
            gone[d] = gone.get(d, 0) + 1
        left = []
        for key in self.keys:
            if gone.get(key, 0):
                gone[key] -= 1
                self.filter.discard(key)
            else:
                left.append(key)
        self.keys = left
        if not all(key in self.filter for key in set(left) & set(digests)):
            self.filter.buckets //= 2
            self._resized()

    def row(self) -> dict:
        return {"kind": "filter", "part": self.number, "bits": self.bits, "marks": self.filter.to_bytes(), "keys": np.array(self.keys, dtype="<i8").tobytes()}


def _pass(schema: pa.Schema, bits: int, start: int, action: str):
    """Rows of parts, each part's filter first, against the filters.

    ``insert``: each row becomes ``new`` or ``hit``; new digests are entered.  ``enter``: all are entered unseen.
    ``probe``: only hits are passed on.  ``drop``: digests are taken out.  All but ``probe`` return the filters.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: _Part | None = None

        def ended() -> Iterator[pa.RecordBatch]:
            if part is not None and action != "probe":
                yield pa.RecordBatch.from_pylist([part.row()], schema=schema)

        for batch in batches:
            numbers = batch.column("part").to_numpy()
            digests = batch.column("digest").to_pylist()
            filters = np.flatnonzero(np.array([k == "filter" for k in batch.column("kind").to_pylist()]))
            loaded = {int(i): batch.slice(int(i), 1).to_pylist()[0] for i in filters}
            kinds: list[str | None] = [None] * batch.num_rows
            for i, number in enumerate(numbers.tolist()):
                if part is None or part.number != number:
                    yield from ended()
                    row = loaded.get(i)
                    part = _Part(number, row["bits"], start, row["marks"], row["keys"]) if row else _Part(number, bits, start)
                if i in loaded:
                    continue
                d = digests[i]
                if action == "drop":
                    part.drop([d])
                elif action != "enter" and d in part.filter:
                    kinds[i] = "hit"
                elif action != "probe":
                    part.add(d)
                    kinds[i] = "new" if action == "insert" else None
            if action in ("insert", "probe"):
                at = batch.schema.get_field_index("kind")
                passed = batch.set_column(at, "kind", pa.array(kinds, pa.string()))
                yield passed.filter(pc.is_valid(passed.column("kind"))).cast(schema)
        yield from ended()

    return run


def _combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a batch as one row, so that a text of very many rows is shuffled once per batch."""
    for batch in batches:
        if batch.num_rows:
            found = pa.Table.from_batches([batch]).group_by(["part", "digest", "sha", "text"]).aggregate([("copies", "sum"), ("last", "max")])
            found = found.rename_columns([{"copies_sum": "copies", "last_max": "last"}.get(c, c) for c in found.column_names])
            yield from found.select(batch.schema.names).cast(batch.schema).to_batches()


class DigestIndex:
    """Live texts with their copies, in the shared folder; rows go in and out in batches.

    ``digest`` maps a text to 64 bits; any function gives right results, since hits are compared by content.
    ``bits`` is the length of a fingerprint, ``start`` the first number of buckets of a filter (a power of two).
    Ids may be of any type that can be compared.  A null text counts as empty.
    """

    def __init__(self, spark: SparkSession, id_type: str = "long", parts: int = 32, bits: int = 32, start: int = 1024, digest=F.xxhash64):
        if start & (start - 1) or not 0 < bits <= 32:
            raise ValueError("start must be a power of two and bits at most 32")
        self.spark, self.parts, self.bits, self.start, self.digest, self.id_type = spark, parts, bits, start, digest, id_type
        self.schema = f"kind string, part int, digest long, sha binary, text string, copies long, last {id_type}, bits int, marks binary, keys binary"
        self.tables: list[str] = []  # bucketed tables of stored texts
        self.filters: DataFrame | None = None
        self.members: DataFrame | None = None  # (id, sha) of all live rows
        self.groups: DataFrame | None = None  # (sha, digest, copies, last) of all live texts

    @staticmethod
    def parts_for(rows: int) -> int:
        return min(1 << 16, max(32, 1 << math.ceil(math.log2(max(1.0, rows / PART_KEYS)))))

    def _rows(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        rows = docs.select(F.col(key).cast(self.id_type).alias("id"), body.alias("text"))
        rows = rows.select("id", "text", self.digest("text").cast("long").alias("digest"), F.unhex(F.sha2("text", 256)).alias("sha"))
        return rows.withColumn("part", F.pmod(F.hash("digest"), F.lit(self.parts)))

    def _arrivals(self, rows: DataFrame) -> DataFrame:
        """(part, digest, sha, text, copies, last), copies within a batch of a task as one row."""
        each = rows.select("part", "digest", "sha", "text", F.lit(1).cast("long").alias("copies"), F.col("id").alias("last"))
        return each.mapInArrow(_combined, each.schema)

    def _against_filters(self, rows: DataFrame, action: str) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        dealt = empty.unionByName(rows, allowMissingColumns=True)
        if self.filters is not None:
            filters = self.filters
            if action != "insert":  # only parts that are met
                filters = filters.join(rows.select("part").distinct(), "part", "left_semi")
            dealt = dealt.unionByName(filters, allowMissingColumns=True)
        dealt = dealt.repartition(self.parts, "part").sortWithinPartitions("part", F.desc_nulls_last("kind"))
        return dealt.mapInArrow(_pass(to_arrow_schema(dealt.schema), self.bits, self.start, action), dealt.schema)

    def _bucketed(self, rows: DataFrame) -> str:
        """``rows`` as a table by kind, bucketed by digest."""
        name = f"texts_{uuid.uuid4().hex}"
        writer = rows.write.option("path", new_path(self.spark, "texts")).partitionBy("kind")
        writer.bucketBy(self.parts, "digest").sortBy("digest").saveAsTable(name)
        return name

    def _same_text(self, hits: DataFrame, how: str) -> DataFrame:
        """``hits`` that equal (``left_semi``) or do not equal (``left_anti``) a stored text under their digest."""
        found = []
        for name in self.tables:
            texts = self.spark.table(name).where("kind = 'new'").select(F.col("digest").alias("__digest"), F.col("text").alias("__text"))
            # only the digest is a join key, so the buckets stay where they are
            same = (F.col("digest") == F.col("__digest")) & F.nullif(F.col("text"), F.col("__text")).isNull()
            left = hits.join(texts, same, how)
            if how == "left_anti":
                hits = left
            found.append(left)
        if how == "left_anti":
            return hits
        whole = found[0]
        for more in found[1:]:  # a text is stored once
            whole = whole.unionByName(more)
        return whole

    def _keep_filters(self, changed: DataFrame) -> None:
        """Filters of parts that were met replace their older state."""
        if self.filters is not None:
            changed = changed.unionByName(self.filters.join(changed.select("part").distinct(), "part", "left_anti"))
        self.filters = written(changed, "filters")

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Take in all rows of ``docs``."""
        rows = self._rows(docs, key, text)
        met = self._bucketed(self._against_filters(self._arrivals(rows), "insert"))
        self.tables.append(met)
        placed = self.spark.table(met)
        columns = ["kind", "part", "bits", "marks", "keys"]
        filters = placed.where("kind = 'filter'").select(columns)
        hits = placed.where("kind = 'hit'").select("part", "digest", "sha", "text", "copies", "last")
        at = new_path(self.spark, "unlike")
        unlike = stored(self._same_text(hits, "left_anti"), at)
        self._keep_filters(filters)
        if not unlike.isEmpty():  # hits by chance: one row per text is stored and entered without asking the filter
            fresh = unlike.groupBy("part", "digest", "sha", "text").agg(F.sum("copies").alias("copies"), F.max("last").alias("last"))
            extra = self._bucketed(fresh.withColumn("kind", F.lit("new")))
            entered = self._against_filters(self.spark.table(extra).select("part", "digest"), "enter")
            self._keep_filters(entered.where("kind = 'filter'").select(columns))
            self.tables.append(extra)
        removed(self.spark, at)
        # a hit equals a stored text byte for byte by now, so the digest of the text names its class
        counted = placed.where("kind <> 'filter'").select("sha", "digest", "copies", "last")
        if self.groups is not None:
            counted = counted.unionByName(self.groups)
        self.groups = written(counted.groupBy("sha", "digest").agg(F.sum("copies").alias("copies"), F.max("last").alias("last")), "groups")
        members = rows.select("id", "sha", "digest")
        self.members = written(members if self.members is None else self.members.unionByName(members), "members")

    def contains(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(``key``, ``text_sha256``) of the rows of ``docs`` whose text is live."""
        rows = self._rows(docs, key, text)
        if self.groups is None:
            return rows.limit(0).select(F.col("id").alias(key), F.lower(F.hex("sha")).alias("text_sha256"))
        hits = written(self._against_filters(self._arrivals(rows), "probe").select("part", "digest", "sha", "text"), "hits")
        live = self._same_text(hits, "left_semi").select("sha").distinct()
        return rows.select("id", "sha").join(live, "sha").select(F.col("id").alias(key), F.lower(F.hex("sha")).alias("text_sha256"))

    def delete(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Take out the rows that equal a row of ``docs`` in id and text; others of ``docs`` are passed over."""
        if self.groups is None:
            return
        gone = written(self.contains(docs, key, text).select(F.col(key).alias("id"), F.unhex("text_sha256").alias("sha")).distinct(), "gone")
        met, left = self.members.alias("m"), gone.alias("g")
        same = (F.col("m.sha") == F.col("g.sha")) & F.col("m.id").eqNullSafe(F.col("g.id"))
        self.members = written(met.join(left, same, "left_anti"), "members")
        touched = gone.select("sha").distinct()
        again = self.members.join(touched, "sha", "left_semi").groupBy("sha", "digest").agg(F.count(F.lit(1)).alias("copies"), F.max("id").alias("last"))
        dead = written(self.groups.join(touched, "sha", "left_semi").join(again, "sha", "left_anti"), "dead")
        self.groups = written(self.groups.join(touched, "sha", "left_anti").unionByName(again), "groups")
        out = dead.select(F.pmod(F.hash("digest"), F.lit(self.parts)).alias("part"), "digest")
        if out.isEmpty():
            return
        changed = self._against_filters(out, "drop").where("kind = 'filter'")
        self._keep_filters(changed.select("kind", "part", "bits", "marks", "keys"))
        self.tables = [
            self._bucketed(self.spark.table(n).where("kind = 'new'").join(dead.select("sha"), "sha", "left_anti").select("kind", "part", "digest", "sha", "text", "copies", "last"))
            for n in self.tables
        ]

    def classes(self) -> DataFrame:
        """One row per live row: id, keep_id, group_size, kept, text_sha256."""
        if self.groups is None:
            return self.spark.createDataFrame([], f"id {self.id_type}, keep_id {self.id_type}, group_size long, kept boolean, text_sha256 string")
        groups = self.groups.select("sha", F.col("copies").alias("group_size"), F.col("last").alias("keep_id"))
        found = self.members.select("id", "sha").join(groups, "sha")
        return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **index) -> DataFrame:
    """Each row of ``docs`` with the row that stays of all rows with the same text.

    Returns ``key``, keep_id (the largest id of the group), group_size long, kept boolean (the id is that
    one), text_sha256 string.

    A null text counts as empty, and empty texts equal each other.  Texts are compared whole, whatever their
    length.  Rows without an id are the smallest of their group; a group without any id keeps them.  Rows that
    repeat the largest id with the same text cannot be told apart: all are kept.  An empty table gives an
    empty result.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    made = DigestIndex(spark, docs.schema[key].dataType.simpleString(), index.pop("parts", None) or DigestIndex.parts_for(docs.count()), **index)
    made.insert(docs, key, text)
    return made.classes().withColumnRenamed("id", key)


def copies_sql() -> str:
    return """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))"""
