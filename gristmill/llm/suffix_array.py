"""Removal of repeated byte strings by a difference-cover suffix sort.

Runs of windows that share an anchor are opened first (see ``rolling``); a run found more than once
repeats as a whole.  What is left are different runs under one anchor, and their suffixes are sorted
to the depth of a window by the difference cover {1, 2} modulo 3:

* suffixes at positions 1 and 2 modulo 3 are sampled; tuples of their bytes are sorted and named,
  and names of names, at positions of the same class, are sorted and named again until they reach
  through the window;
* the remaining suffixes are merged in: for any two classes there is a shift of 0, 1 or 2 bytes that
  makes both suffixes sampled, so two windows agree if their bytes before the shift do and the
  sampled suffixes behind it are adjacent under one name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from gristmill.llm import rolling
from gristmill.llm.common import cut, numbered, slices, written

LENGTH = 200
ANCHOR = 64

# Groups of one anchor with more different runs than this are sorted by Spark, row by row; smaller ones
# are packed into arrays of about CHUNK bytes and sorted in a task each.  A run has at most
# 2 * LENGTH - ANCHOR bytes and sorting takes some 40 bytes per byte, so a group needs 0.5 GB at most.
GROUP = 32_768
CHUNK = 1 << 21

RUN_SCHEMA = "k1 long, k2 long, start int, count int, anchor long, content long"
BODY_SCHEMA = "k1 long, k2 long, start int, count int, anchor long, body binary"


def _steps(length: int) -> tuple[int, int, int]:
    """Tuple sizes (a, b) and reach r: names of a bytes cover b bytes, names of b bytes cover r.

    Three names at shifts divisible by 3 cover each next size, and r misses the window by three bytes
    at most, which are compared as they are.
    """
    reach = length - 3
    b = reach - 2 * ((reach // 3) // 3 * 3)
    a = b - 2 * ((b // 3) // 3 * 3)
    return a, b, reach


def _runs_of(length: int, anchor: int):
    def runs(text: str) -> rolling.Runs:
        data = np.frombuffer(text.encode(), np.uint8)
        return rolling.spread_runs(rolling.byte_grams(data, anchor), length - anchor + 1)

    return runs


def _source_key(k1, start):
    """Key of the run that starts at byte ``start`` of the text with key ``k1``; at -1 that of the text itself."""
    with np.errstate(over="ignore"):
        return rolling.mix(np.atleast_1d(np.asarray(start, np.int64) + 2).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.atleast_1d(np.asarray(k1, np.int64)).view(np.uint64))


@F.arrow_udf(LongType())
def source_keys(k1: pa.Array, start: pa.Array) -> pa.Array:
    """``_source_key`` of each row."""
    return rolling.signed(_source_key(k1.to_numpy(zero_copy_only=False), start.to_numpy(zero_copy_only=False)))


def _open_runs(table, length: int, anchor: int, wanted=None):
    """The runs whose anchor is in the table, with a digest of their bytes.

    With a table of wanted sources (``_source_key``) only the runs that are in that, too, and their bytes instead
    of the digest; texts that are no source are not searched for anchors again.
    """
    runs_of = _runs_of(length, anchor)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            keys = [batch.column(k).to_numpy() for k in ("k1", "k2")]
            is_source = rolling.in_table(wanted.value, _source_key(keys[0], -1)) if wanted else None
            found, rows, last = [], [], []
            for at, text in enumerate(batch.column("text")):
                if wanted and not is_source[at]:
                    continue
                text = text.as_py()
                runs = runs_of(text)
                if not len(runs.anchor):
                    continue
                hit = rolling.in_table(table.value, runs.anchor)
                if wanted:
                    hit &= rolling.in_table(wanted.value, _source_key(keys[0][at], runs.start))
                hit = np.flatnonzero(hit)
                if not len(hit):
                    continue
                data = text.encode()
                runs = rolling.Runs(*(part[hit] for part in runs))
                ends = (runs.start + runs.count + length - 1).tolist()
                bodies = [data[x:y] for x, y in zip(runs.start.tolist(), ends)]
                found.append(runs)
                rows.append(np.full(len(hit), at))
                last += bodies if wanted else [hashlib.blake2b(b, digest_size=8).digest() for b in bodies]
            empty = np.zeros(0, np.int64)
            place = np.concatenate([empty, *rows])
            start, count = (np.concatenate([empty, *(getattr(f, n) for f in found)]).astype(np.int32) for n in ("start", "count"))
            anchors = np.concatenate([empty.view(np.uint64), *(f.anchor for f in found)])
            body = pa.array(last, pa.binary()) if wanted else pa.array(np.frombuffer(b"".join(last), "<i8"))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(k[place]) for k in keys), pa.array(start), pa.array(count), rolling.signed(anchors), body],
                names=["k1", "k2", "start", "count", "anchor", "body" if wanted else "content"],
            )

    return run


def _rank(*parts: np.ndarray) -> np.ndarray:
    """Rank of each tuple among the distinct tuples, in sorted order."""
    ranks = parts[0].astype(np.int64)
    for part in parts[1:]:
        key = ranks * (np.int64(part.max()) + 1) + part
        ranks = np.unique(key, return_inverse=True)[1].astype(np.int64)
    return ranks


def sorted_repeats(bodies: list[bytes], counts: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the strings start at two places: a flag for each of their first ``counts`` positions.

    Names of 8 bytes are their values; each next name is the rank of three (at last two) names at shifts
    that are multiples of 3, so sampled positions meet sampled positions only.
    """
    reach = length - 3
    sizes = np.array([len(b) for b in bodies])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(bodies) + bytes(length + 16), np.uint8)
    total = int(sizes.sum())
    place = np.arange(total) - np.repeat(starts, sizes)
    sampled = np.flatnonzero(place % 3)
    value = np.zeros(len(sampled), np.uint64)
    for k in range(8):
        value = value << np.uint64(8) | data[sampled + k]
    names = np.zeros(len(data) + length, np.int32)
    names[sampled] = np.unique(value, return_inverse=True)[1]
    del value, place
    size = 8
    while size < reach:
        third = min(size // 3 * 3, (reach - size) // 2 // 3 * 3)
        if size + 2 * third == reach and third:
            shifts: tuple[int, ...] = (third, 2 * third)
        elif (reach - size) % 3 == 0 and reach - size <= size:
            shifts = (reach - size,)
        elif size + 2 * (size // 3 * 3) < reach:
            shifts = (size // 3 * 3, 2 * (size // 3 * 3))
        else:  # reach - size is no multiple of 3 away: name fewer bytes, so that the next step fits
            shifts = (3,)
        if size + shifts[-1] > reach or not shifts[0]:
            break
        names[sampled] = _rank(names[sampled], *[names[sampled + s] for s in shifts])
        size += shifts[-1]
    # what the names do not reach is compared as bytes, with those that a shift puts in front
    behind = length - size
    window = np.repeat(np.arange(len(bodies)), counts)
    at = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
    base, weight = starts[window] + at, copies[window]
    found = np.zeros(len(window), bool)
    for shift in range(3):
        own = np.flatnonzero((at + shift) % 3)
        if not len(own):
            continue
        first = base[own]
        rank = names[first + shift].astype(np.int64)
        for k in [*range(shift), *range(shift + size, length)]:
            rank = rank * 256 + data[first + k]
            if behind > 4:
                rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        # equal windows are neighbours in rank order
        rank = np.unique(rank, return_inverse=True)[1]
        found[own] |= np.bincount(rank, weights=weight[own])[rank] > 1
    return found


def _sort_groups(length: int):
    """Islands (anchor, content, at, long) of repeated windows; the input is sorted by anchor, then content."""

    def islands(rows: list[tuple]) -> pa.RecordBatch:
        columns: list = [[]] * 4
        if rows:
            counts = np.array([r[2] for r in rows])
            flags = sorted_repeats([r[4] for r in rows], counts, np.array([r[3] for r in rows]), length)
            # one place that repeats nothing before each string and one at the end keep islands apart
            first = np.cumsum(counts) - counts + np.arange(1, len(rows) + 1)
            own = np.zeros(len(flags) + len(rows) + 1, bool)
            own[np.arange(len(flags)) + np.repeat(np.arange(1, len(rows) + 1), counts)] = flags
            turns = np.flatnonzero(own[1:] != own[:-1]) + 1
            begin, end = turns[::2], turns[1::2]
            of = np.searchsorted(first, begin, "right") - 1
            columns = [np.array([r[0] for r in rows])[of], np.array([r[1] for r in rows])[of], begin - first[of], end - begin]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c).cast(t) for c, t in zip(columns, types)], names=["anchor", "content", "at", "long"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in slices(batches, 512):
            columns = [batch.column(c).to_pylist() for c in ("anchor", "content", "count", "copies", "body")]
            for row in zip(*columns):
                if last == row[:2]:  # copies of a text give the same run again
                    continue
                if held > CHUNK and last[0] != row[0]:
                    yield islands(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
                last = row[:2]
        yield islands(rows)

    return run


def _samples(first: int, reach: int):
    """A row for each sampled position: its tuple and the bytes just before it and behind its reach."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            ids, at, heads, before, behind = [], [], [], [], []
            for sid, body in zip(batch.column("sid").to_pylist(), batch.column("body")):
                body = body.as_py()
                places = [q for q in range(1, len(body) - first + 1) if q % 3]
                ids += [sid] * len(places)
                at += places
                heads += [body[q : q + first] for q in places]
                before += [body[max(0, q - 2) : q] for q in places]
                behind += [body[q + reach : q + reach + 3] for q in places]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(at, pa.int32()), *(pa.array(x, pa.binary()) for x in (heads, before, behind))],
                names=["sid", "q", "head", "before", "behind"],
            )

    return run


def _named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Replace ``keys`` by their rank among all distinct keys, in sorted order."""
    ranked = numbered(rows.select(*keys).distinct(), keys, name)
    return rows.join(ranked, keys).drop(*keys)


def _tripled(rows: DataFrame, name: str, shift: int, width: int) -> DataFrame:
    """The names at ``shift`` and ``width`` bytes further on, in the same string and class."""
    order = Window.partitionBy("sid", F.col("q") % 3).orderBy("q")
    return rows.withColumn("n1", F.lead(name, shift // 3).over(order)).withColumn("n2", F.lead(name, width // 3).over(order))


def repeated_windows(strings: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sid, at): windows of ``length`` bytes that start at two places of ``strings`` (sid, body, count, copies).

    A place counts ``copies`` times; only the first ``count`` places of a string are asked for.
    """
    first, second, reach = _steps(length)
    rows = strings.select("sid", "body").mapInArrow(_samples(first, reach), "sid long, q int, head binary, before binary, behind binary")
    rows = cut(_named(written(rows, "samples"), ["head"], "n0"))
    rows = _tripled(rows, "n0", (second - first) // 6 * 3, second - first).where("n2 is not null")
    rows = cut(_named(rows, ["n0", "n1", "n2"], "m0"))
    rows = _tripled(rows.withColumnRenamed("m0", "n0"), "n0", (reach - second) // 6 * 3, reach - second).where("n2 is not null")

    def shifted(shift: int) -> Column:
        return F.struct(
            F.lit(shift).alias("shift"),
            (F.col("q") - shift).alias("at"),
            F.substring("before", 3 - shift, shift).alias("head") if shift else F.lit(b"").alias("head"),
            F.substring("behind", 1, 3 - shift).alias("tail"),
        )

    # position 1 has one byte before it, so it cannot be reached by a shift of 2
    whole = F.when(F.octet_length("before") == 2, shifted(2))
    short = F.struct(F.lit(1).alias("shift"), (F.col("q") - 1).alias("at"), F.col("before").alias("head"), F.substring("behind", 1, 2).alias("tail"))
    one = F.when(F.octet_length("before") == 1, short).otherwise(shifted(1))
    merged = rows.select("sid", "n0", "n1", "n2", F.explode(F.array_compact(F.array(shifted(0), one, whole))).alias("w"))
    merged = merged.select("sid", "n0", "n1", "n2", "w.*").join(strings.select("sid", "count", "copies"), "sid")
    key = ["shift", "head", "n0", "n1", "n2", "tail"]
    asked = written(merged.where((F.col("at") >= 0) & (F.col("at") < F.col("count"))), "merged")
    twice = asked.groupBy(*key).agg(F.sum("copies").alias("__n")).where("__n > 1").select(*key)
    return asked.join(twice, key, "left_semi").select("sid", "at").distinct()


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Equal texts share the key (k1, k2), 128 bits of hashes; what repeats depends on the text alone."""
    text = F.col("text")
    return docs.select(*columns, "text", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, start, count): ``count`` windows from byte ``start`` on that also start elsewhere."""
    texts = _keyed(docs.where(F.col("text").isNotNull()))
    anchors = rolling.repeated_anchors(texts, _runs_of(length, anchor))
    table = rolling.anchor_table(docs.sparkSession, anchors)
    opened = written(texts.mapInArrow(_open_runs(table, length, anchor), RUN_SCHEMA), "runs")
    run = ["anchor", "content"]
    places = opened.select("k1", "k2", "start", *run).distinct()
    contents = opened.groupBy(*run, "count").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "start")).alias("source")
    )
    contents = written(contents, "contents")
    whole = contents.where("copies > 1").select(*run, F.lit(0).alias("at"), F.col("count").alias("long"))

    # different runs under one anchor, at least one of them single: their bytes are read once more
    mixed = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs"), F.min("copies").alias("least"))
    mixed = cut(mixed.where("runs > 1 and least = 1").select("anchor", "runs"))
    wanted = contents.join(mixed, "anchor").select(*run, "copies", "runs", "source.k1", "source.k2", "source.start")
    wanted = cut(wanted)
    # one occurrence of each is enough; a second table keeps nearly all others out of the shuffle
    sources = wanted.select("k1", F.explode(F.array(F.lit(-1), F.col("start"))).alias("start"))
    sources = sources.select(source_keys("k1", "start").alias("anchor"))
    tables = [rolling.anchor_table(docs.sparkSession, rows) for rows in (mixed, sources)]
    bodies = texts.mapInArrow(_open_runs(tables[0], length, anchor, tables[1]), BODY_SCHEMA)
    strings = bodies.join(wanted, ["anchor", "k1", "k2", "start"]).select(*run, "count", "copies", "runs", "body")
    strings = written(strings, "strings")
    small = strings.where(F.col("runs") <= GROUP).repartition("anchor").sortWithinPartitions(*run)
    sorted_in_tasks = small.mapInArrow(_sort_groups(length), "anchor long, content long, at int, long int")

    large = strings.where(F.col("runs") > GROUP).dropDuplicates(run).drop("runs")
    large = written(large.withColumn("sid", F.monotonically_increasing_id()), "large")
    pieces = whole.unionByName(sorted_in_tasks.join(whole.select(*run), run, "left_anti"))
    if not large.isEmpty():
        found = repeated_windows(large.select("sid", "body", "count", "copies"), length)
        island = Window.partitionBy("sid").orderBy("at")
        islands = found.withColumn("island", F.col("at") - F.row_number().over(island)).groupBy("sid", "island").agg(
            F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("long")
        )
        single = large.where("copies = 1").select("sid", *run)
        pieces = pieces.unionByName(islands.join(single, "sid").select(*run, "at", "long"))
    return places.join(pieces, run).select("k1", "k2", (F.col("start") + F.col("at")).alias("start"), F.col("long").alias("count"))


def _cleaned(length: int):
    """Counts and digest of what is left of each text without the bytes its spans cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                gone = np.zeros(len(data) + 1, np.int64)
                for span in spans or ():
                    gone[span["start"]] += 1
                    gone[span["start"] + span["count"] + length - 1] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                sizes.append(len(data))
                removed.append(int(covered.sum()))
                runs.append(int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if len(data) else 0)
                digests.append(hashlib.sha256(data[~covered].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Removed is each byte that a string of ``length`` bytes covers which also starts anywhere else, in
    the same document too; strings are judged on the input.

    Null and empty texts have no bytes; texts shorter than ``length`` lose nothing; texts are read
    whole whatever their length; equal texts (repeated rows too) lose all bytes of all copies; null ids
    stay; an empty table gives no rows; other columns are ignored.
    """
    spans = repeated_spans(docs, length, anchor).groupBy("k1", "k2")
    spans = spans.agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    rows = _keyed(docs, "doc_id").join(spans, ["k1", "k2"], "left").drop("k1", "k2")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(_cleaned(length), schema)
