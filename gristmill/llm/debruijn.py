"""Removal of repeated word passages by edges of a De Bruijn graph, gathered by anchor runs.

Every ``k`` successive words are an edge between the (k-1)-word nodes they begin and end with.  Edges
are gathered by anchor runs, so copies of a passage are a handful of equal runs instead of thousands
of edges; only distinct runs are opened.  Runs with an equal anchor and digest of their words repeat
as a whole, other runs where their edges (anchor and two node hashes; words are not compared) are found
more than once, and the union of their source coordinates is what repeats.  Anchor runs take the place
of the graph's compaction: the paths that ``_compact`` numbers have no effect on what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm import rolling
from gristmill.llm.common import slices, written

WORDS = 35
ANCHOR = 12  # words of an anchor; there are WORDS - ANCHOR + 1 in a window

RUN_SCHEMA = "k1 long, k2 long, start int, count int, anchor long, content long, first long, last long, nodes array<int>"


def _word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = rolling.word_bounds(data)
    return data, starts, ends, rolling.word_hashes(data, starts, ends)


def _runs_of(window: int, anchor: int):
    def runs(text: str) -> rolling.Runs:
        return rolling.spread_runs(rolling.word_grams(_word_hashes(text)[3], anchor), window - anchor + 1)

    return runs


def _content(data: np.ndarray, first: int, last: int) -> int:
    """A digest of the words themselves, joined by single spaces."""
    words = data[first:last].tobytes().split()
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def _open_runs(table, window: int, anchor: int):
    """The runs whose anchor may repeat, with the digest of their words and their nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            columns: list[list] = [[] for _ in range(9)]
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text")):
                data, starts, ends, hashes = _word_hashes(text.as_py())
                runs = rolling.spread_runs(rolling.word_grams(hashes, anchor), window - anchor + 1)
                if not len(runs.anchor):
                    continue
                keep = np.flatnonzero(rolling.in_table(table.value, runs.anchor))
                if not len(keep):
                    continue
                nodes = rolling.word_grams(hashes, window - 1)
                short = nodes.astype(np.uint32).view(np.int32)
                a, n = runs.start[keep], runs.count[keep]
                columns[0] += [k1] * len(keep)
                columns[1] += [k2] * len(keep)
                columns[2] += a.tolist()
                columns[3] += n.tolist()
                columns[4] += runs.anchor[keep].view(np.int64).tolist()
                columns[5] += [_content(data, starts[x], ends[x + c + window - 2]) for x, c in zip(a, n)]
                columns[6] += nodes[a].view(np.int64).tolist()
                columns[7] += nodes[a + n].view(np.int64).tolist()
                columns[8] += [short[x : x + c + 1] for x, c in zip(a, n)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["k1", "k2", "start", "count", "anchor", "content", "first", "last", "nodes"],
            )

    return run


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Equal texts share the key (k1, k2), 128 bits of hashes; what repeats depends on the text alone."""
    text = F.col("text")
    return docs.select(*columns, "text", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def repeated_spans(docs: DataFrame, window: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, start, count, path): windows of each text that also start elsewhere, by compact paths.

    ``count`` windows from word ``start`` on are a stretch of ``path``.  Rows grow with what repeats,
    not with the square of any group: equal runs are counted by partial sums, and occurrences meet
    their distinct run in an equi-join, whose skew the engine splits.
    """
    spark = docs.sparkSession
    texts = _keyed(docs.where(F.col("text").isNotNull()))
    repeated = rolling.repeated_anchors(texts, _runs_of(window, anchor))
    table = rolling.anchor_table(spark, repeated)
    opened = written(texts.mapInArrow(_open_runs(table, window, anchor), RUN_SCHEMA), "runs")

    run = ["anchor", "content"]
    # copies of a text share their key: one row per coordinate, with its number of copies
    places = opened.groupBy("k1", "k2", "start", "count", *run).agg(F.count(F.lit(1)).alias("copies"))
    contents = opened.groupBy(*run, "count", "first", "last", "nodes").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "start")).alias("source")
    )
    contents = written(contents, "contents")

    # edges: pairs of successive nodes under one anchor; those of runs with copies repeat anyway
    edge = ["anchor", "a", "b"]
    edges = contents.select(*run, "copies", F.col("nodes").alias("n"), F.posexplode("nodes").alias("at", "a"))
    edges = edges.withColumn("b", F.get("n", F.col("at") + 1)).where("b is not null").drop("n")
    twice = edges.groupBy(*edge).agg(F.sum("copies").alias("copies")).where("copies > 1").select(*edge)
    single = edges.where("copies = 1").join(twice, edge, "left_semi").select(*run, "at")
    island = Window.partitionBy(*run).orderBy("at")
    partial = (
        single.withColumn("island", F.col("at") - F.row_number().over(island))
        .groupBy(*run, "island")
        .agg(F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("long"))
        .drop("island")
    )
    ends = contents.select(*run, "count", "first", "last", "source", "copies")
    pieces = (
        ends.where("copies > 1")
        .select(*run, F.lit(0).alias("at"), F.col("count").alias("long"), "count", "first", "last", "source")
        .unionByName(
            partial.join(ends.drop("copies"), run).select(*run, "at", "long", "count", "first", "last", "source")
        )
    )
    pieces = written(pieces, "pieces")
    paths = _compact(pieces)
    spans = places.join(paths, run)
    return spans.select("k1", "k2", (F.col("start") + F.col("at")).alias("start"), F.col("long").alias("count"), "path")


def _compact(pieces: DataFrame) -> DataFrame:
    """(anchor, content, at, long, path): pieces of one path follow each other through nodes that do not branch.

    Joins with the degrees of the end nodes tell where a path goes on; pieces that follow each other
    in the text they were first seen in then share the path that begins there.
    """
    leaving = pieces.where("at = 0").groupBy(F.col("first").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    entering = (
        pieces.where("at + long = count").groupBy(F.col("last").alias("node")).agg(F.count(F.lit(1)).alias("in"))
    )
    through = leaving.join(entering, "node").where("out = 1 and in = 1").select("node", F.lit(True).alias("through"))
    begun = pieces.join(through, (F.col("first") == F.col("node")) & (F.col("at") == 0), "left").select(
        "anchor", "content", "at", "long", "source",
        (F.col("source.start") + F.col("at")).alias("from"),
        F.coalesce("through", F.lit(False)).alias("through"),
    )
    text = Window.partitionBy("source.k1", "source.k2").orderBy("from")
    ended = F.lag(F.col("from") + F.col("long")).over(text)
    fresh = F.when(F.col("through") & (ended == F.col("from")), 0).otherwise(1)
    numbered = begun.withColumn("fresh", fresh).withColumn("no", F.sum("fresh").over(text))
    return numbered.select("anchor", "content", "at", "long", F.struct("source.k1", "source.k2", "no").alias("path"))


def _cleaned(window: int, full: bool):
    """What is left of each text without the words its spans cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_n, removed_n, out = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                words = (text.as_py() or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for span in spans or ():
                    gone[span["start"]] += 1
                    gone[span["start"] + span["count"] + window - 1] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                words_n.append(len(words))
                removed_n.append(int(covered.sum()))
                kept = b" ".join(words if not spans else [w for w, c in zip(words, covered) if not c])
                out.append(kept.decode() if full else hashlib.sha256(kept).hexdigest())
            drop = {"text", "spans"}
            names = [n for n in batch.schema.names if n not in drop]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(out, pa.string())],
                names=[*names, "n_words", "n_removed", "kept"],
            )

    return run


def _with_spans(docs: DataFrame, window: int, anchor: int, columns: list[str]) -> DataFrame:
    spans = (
        repeated_spans(docs, window, anchor)
        .select("k1", "k2", "start", "count")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    )
    return _keyed(docs, *columns).join(spans, ["k1", "k2"], "left").drop("k1", "k2")


def remove_repeats(docs: DataFrame, window: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    Removed are the words that a window of ``window`` words covers whose sequence also starts anywhere
    else, in the same document too; windows are judged on the input.  Words are what stands between
    ASCII white space, unchanged, and the kept ones are joined by one space.

    Null and empty texts have no words; texts shorter than the window lose nothing; texts are read
    whole whatever their length; equal texts (repeated rows too) lose all words of all copies; null ids
    stay; an empty table gives no rows; other columns are ignored.
    """
    rows = _with_spans(docs, window, anchor, ["doc_id"])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    return rows.mapInArrow(_cleaned(window, False), schema).withColumnRenamed("kept", "kept_sha256")


def cut_repeats(docs: DataFrame, window: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with the kept words as text; rows of which nothing is left go.  Untouched texts stay as they are.

    Repeats are judged over all rows, so no copy of a passage of ``window`` words survives.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = _with_spans(docs, window, anchor, [F.struct(*others).alias("row")])
    untouched = rows.where("spans is null").select("row.*", "text")
    changed = rows.where("spans is not null")
    schema = f"row {changed.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    changed = changed.mapInArrow(_cleaned(window, True), schema).where("n_words > n_removed")
    return untouched.unionByName(changed.select("row.*", F.col("kept").alias("text"))).select(*docs.columns)
