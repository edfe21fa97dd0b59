"""Near copies by n-gram Jaccard similarity: MinHash banding, then exact verification.

Every text becomes the set of its word n-grams; texts with one set are one class, and only classes
are compared.  Each tree has a band of MinHash values; classes that share a whole band are candidates.
A band is as long as the trees together still reach the target recall at the threshold, which follows
from the parameters alone: no longer labels are made and no depth is tried on the data.  Candidates are
verified on the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import rolling
from gristmill.llm.common import cut, slices, written
from gristmill.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TREES = 24
LABEL = 8  # MinHash values of a label
RECALL = 0.99999  # of a pair at the threshold
BLOCK = 256  # classes of a block


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> int:
    """The longest prefix, shortened from the whole label, that reaches the recall at the threshold."""
    for depth in range(label, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("no prefix reaches the recall; use more trees")


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams; a shorter text is one n-gram of all its words."""
    data = np.frombuffer(text.encode(), np.uint8)
    hashes = rolling.word_hashes(data, *rolling.word_bounds(data))
    if not len(hashes):
        return hashes
    return np.unique(rolling.word_grams(hashes, min(words, len(hashes))))


def _permutations(n: int) -> np.ndarray:
    return rolling.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def min_hashes(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of the n-grams under each of the permutations, in slices that stay in the cache."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096]
        least = np.minimum(least, (part[:, None] * factors[None, :]).min(0))
    return least


def prefix_keys(values: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One key per tree for the first ``depth`` values of its label; equal prefixes have equal keys."""
    label = len(values) // trees
    key = np.arange(trees, dtype=np.uint64)
    for d in range(depth):
        key = rolling.mix(key * np.uint64(0x9E3779B97F4A7C15) + values[d::label])
    return key


def _signed(words: int, trees: int, label: int, depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the values that a prefix of this depth reads are worked out
        factors = _permutations(trees * label).reshape(trees, label)[:, :depth].ravel()
        for batch in batches:
            ids, keys = [], []
            for text in batch.column("text"):
                grams = shingles(text.as_py() or "", words)
                ids.append(hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest() if len(grams) else None)
                found = prefix_keys(min_hashes(grams, factors), trees, depth) if len(grams) else np.zeros(0, np.uint64)
                keys.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_key")), pa.array(ids, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "set_id", "keys"],
            )

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verified(words: int, threshold: float):
    """Links of each (cluster, i, j) block pair: weights per class, and a spanning forest of the links."""

    def compare(rows: list[tuple], left: int, right: int) -> Iterator[tuple]:
        unique = {r[0]: r for r in rows}
        order = sorted(unique)
        at = {s: n for n, s in enumerate(order)}
        sets = [shingles(unique[s][3], words) for s in order]
        keys = np.array([unique[s][2] for s in order])
        size = [unique[s][1] for s in order]
        block = np.array([unique[s][4] for s in order])
        parent, weight = list(range(len(order))), [0] * len(order)

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = n = parent[parent[n]]
            return n

        for s in order:
            n = at[s]
            others = np.flatnonzero(block == (right if block[n] == left else left)) if left != right else np.arange(n)
            others = others[others < n]
            # both must be candidates: some tree has them under one prefix
            for m in others[(keys[others] == keys[n]).any(1)]:
                a, b = sets[n], sets[m]
                if min(len(a), len(b)) < threshold * max(len(a), len(b)):
                    continue
                if _overlap(a, b) >= threshold:
                    weight[n] += size[m]
                    weight[m] += size[n]
                    if root(n) != root(m):
                        parent[root(n)] = root(m)
                        yield order[n], order[m], 0
        for s, w in zip(order, weight):
            if w:
                yield s, None, w

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [[], [], []]
        types = (pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["a", "b", "links"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for batch in slices(batches, 64):
            columns = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "set_id", "size", "keys", "text", "block")]
            for cluster, i, j, *row in zip(*columns):
                if (cluster, i, j) != key:
                    if len(rows) > 1:
                        found += compare(rows, key[1], key[2])
                    key, rows = (cluster, i, j), []
                rows.append(tuple(row))
            if len(found) > 10_000:
                yield out(found)
                found = []
        if len(rows) > 1:
            found += compare(rows, key[1], key[2])
        yield out(found)

    return run


def _linked(docs: DataFrame, words: int, threshold: float, trees: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, text_key, set_id), and (set_id, size, root, links) of every class."""
    depth = prefix_depth(threshold, trees, LABEL, recall)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, text_key long, set_id string, keys array<long>"
    signed = written(texts.mapInArrow(_signed(words, trees, LABEL, depth), schema), "signed")
    classes = signed.where("set_id is not null").groupBy("set_id", "keys").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "text_key")).alias("first")
    )
    classes = written(classes, "classes")

    # prefixes that more than one class shares; each class hangs on the least of them
    prefixes = classes.select("set_id", F.posexplode("keys").alias("tree", "key"))
    shared = prefixes.groupBy("tree", "key").agg(F.min("set_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = prefixes.join(shared, ["tree", "key"]).select(F.col("set_id").alias("a"), "b").where("a <> b").distinct()
    clusters = components(near).select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    clusters = cut(clusters.distinct())

    # members of one cluster in blocks of about BLOCK; every pair of blocks is one group of rows
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = classes.join(clusters, "set_id").join(blocks, "cluster")
    members = members.select(
        "cluster", "set_id", "size", "keys", "blocks", F.col("first.doc_id").alias("doc_id"),
        F.col("first.text_key").alias("text_key"), F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("block"),
    )
    same = members["doc_id"].eqNullSafe(texts["doc_id"]) & (members["text_key"] == texts["text_key"])
    held = texts.join(members, same).select("cluster", "set_id", "size", "keys", "text", "blocks", "block")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = held.withColumn("other", other).select(
        "cluster", "set_id", "size", "keys", "text", "block",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )
    dealt = paired.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    found = cut(dealt.mapInArrow(_verified(words, threshold), "a string, b string, links long"))

    roots = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    rooted = classes.select("set_id", "size").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    rooted = rooted.join(links, "set_id", "left").select(
        "set_id", "size", F.coalesce("root", "set_id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")
    )
    return signed.drop("keys"), cut(rooted)


def near_copies(
    docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL
) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document.

    ``class_id`` is the least doc_id of all documents that links connect; ``n_links`` counts the other
    documents whose set of ``words``-word n-grams has a Jaccard similarity of at least ``threshold``
    with this one's, copies included; ``n_copies`` those with the same set.  Words are what stands
    between ASCII white space, unchanged.

    A large group of near copies is compared in pairs of blocks, each one group of rows; tasks return a
    count per class and a spanning forest, never the pairs.  Recall of a pair at the threshold is
    ``recall`` at least, and higher above it; no bucket is capped.

    Null texts and texts without a word link to nothing and are classes of their own; a text of fewer
    words is one n-gram; texts are read whole; rows that repeat an id count as documents; null ids stay
    (and are never a class id unless all ids are null); an empty table gives no rows; other columns are
    ignored.
    """
    rows, classes = _linked(docs, words, threshold, trees, recall)
    joined = rows.join(classes, "set_id", "left")
    least = joined.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = classes.join(least, "root").select("set_id", "class_id", "size", "links")
    return rows.join(named, "set_id", "left").select(
        "doc_id",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0))).cast("long").alias("n_links"),
        (F.coalesce(F.col("size") - 1, F.lit(0))).cast("long").alias("n_copies"),
    )


def keep_one(
    docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL
) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; rows without words all stay."""
    rows, classes = _linked(docs, words, threshold, trees, recall)
    known = rows.where("set_id is not null").join(classes.select("set_id", "root"), "set_id")
    first = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key"))
    repeated = known.groupBy("doc_id", "text_key").count().where("count > 1").drop("count")
    first = first.join(
        repeated, first["__id"].eqNullSafe(repeated["doc_id"]) & (first["__key"] == repeated["text_key"]), "left"
    ).select("__id", "__key", F.col("text_key").isNotNull().alias("__repeated"))
    # texts without words are kept here as they have no class
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    own = F.xxhash64("text")
    kept = docs.where(~wordless).join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (own == F.col("__key")))
    once = kept.where("not __repeated").select(*docs.columns)
    many = kept.where("__repeated").dropDuplicates(["__id", "__key"]).select(*docs.columns)
    return once.unionByName(many).unionByName(docs.where(wordless))
