"""Best-fit packing of token sequences by large-item matching.

Packing depends on lengths only, and lengths are whole numbers up to the capacity.  So the plan is
made over the histogram of lengths (at most ``capacity`` rows, whatever the corpus): how many pieces
of which length go into how many bins.  Pieces then find their place by their rank among the pieces
of their length.  The plan equals the one that would be made piece by piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut
from gristmill.llm.encoding import DEFAULT, encoder
from gristmill.operators.ordered import dense_index

CAPACITY = 2048
# Ranks are numbered within (length, part); more parts mean smaller sorts.
RANK_PARTS = 4096


class Place(NamedTuple):
    """Pieces ``rank`` … ``rank + count - 1`` of this length go, ``each`` to a bin, from ``bin`` on at ``offset``."""

    length: int
    rank: int
    count: int
    each: int
    bin: int
    offset: int


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Place]:
    """Places for all pieces of a histogram length -> count.

    Large pieces (over a third of the capacity, so at most two share a bin) are matched greedily from
    the longest down, each with the longest partner that fits; this pairs as many as can be paired.
    Smaller pieces, longest first, go to the fullest bin that has room, or to a new one.  All bins of
    one step are alike and handled together, so the work does not depend on the counts.
    """
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    places: list[Place] = []
    gaps: list[tuple[int, int, int]] = []  # (room, first bin, bins), sorted
    bins = 0

    def put(length: int, count: int, each: int, first: int, offset: int) -> None:
        places.append(Place(length, used[length], count, each, first, offset))
        used[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    def room(free: int, first: int, n: int) -> None:
        if free and n:
            insort(gaps, (free, first, n))

    large = [n for n in left if 3 * n > capacity]
    while large:
        longest = large[-1]
        at = bisect_left(large, capacity - longest + 1) - 1
        partner = large[at] if at >= 0 else None
        if partner == longest and left[longest] == 1:
            partner = large[at - 1] if at >= 1 else None
        if partner is None:
            n = left[longest]
            put(longest, n, 1, bins, 0)
            room(capacity - longest, bins, n)
        elif partner == longest:
            n = left[longest] // 2
            put(longest, 2 * n, 2, bins, 0)
            room(capacity - 2 * longest, bins, n)
        else:
            n = min(left[longest], left[partner])
            put(longest, n, 1, bins, 0)
            put(partner, n, 1, bins, longest)
            room(capacity - longest - partner, bins, n)
        bins += n
        large = [x for x in large if x in left]

    for length in sorted(left, reverse=True):
        while length in left:
            at = bisect_left(gaps, (length, -1, -1))
            if at < len(gaps):
                free, first, n = gaps.pop(at)
            else:
                free, first, n = capacity, bins, -(-left[length] // (capacity // length))
                bins += n
            each = free // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, each, first, capacity - free)
                room(free - each * length, first, full)
            if full < n:
                rest = min(left.get(length, 0), each - 1)
                if rest:
                    put(length, rest, rest, first + full, capacity - free)
                    room(free - rest * length, first + full, 1)
                    full += 1
                room(free, first + full, n - full)
    return places


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        end = np.zeros(1, dtype="<u4")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.concatenate([encode(text.as_py() or "").astype("<u4"), end])
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, tokenizer: str = DEFAULT, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and a closing id 0, cut into pieces of ``capacity``; the first may be shorter."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(tokenizer, capacity), PIECES)


def _placed(plan: list[Place]):
    """Find each piece's place: the last whose (length, rank) is not behind its own."""
    keys = np.array([(p.length << 48) + p.rank for p in plan], dtype=np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    rank, each, first, offset = (
        np.array([getattr(p, name) for p in plan], dtype=np.int64)[order] for name in ("rank", "each", "bin", "offset")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            own = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + own, side="right") - 1
            i = own - rank[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(first[at] + i // each[at]),
                    pa.array(offset[at] + i % each[at] * length),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str = DEFAULT, capacity: int = CAPACITY) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: one row per piece with its place.

    Texts are encoded once, into a table of pieces in the shared folder.  The driver sees the
    histogram of lengths (at most ``capacity`` rows) and the plan made from it (a few thousand rows).
    Ranks within a length are numbered by parts, so a length that most pieces share is no hot key.

    Null and empty texts are one piece of one id; a text of any length is packed whole; rows that
    repeat an id are packed once each; null ids stay null; an empty table gives no rows; other columns
    are ignored.
    """
    pieces = cut(token_pieces(docs, tokenizer, capacity))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_bins(histogram, capacity)
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS))
    ranked = dense_index(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], part, "rank")
    if not plan:
        plan = [Place(1, 0, 0, 1, 0, 0)]
    return ranked.mapInArrow(_placed(plan), f"{PIECES}, sequence_id long, offset long")
