"""Vectorized rolling hashes over bytes and words, sliding minima and the anchors made from them.

An anchor run (also called a super-k-mer) is a maximal series of windows that share their leftmost
least m-gram.  Equal windows share it wherever they stand, so all copies of a window meet under one
anchor value, and there is about one run per half window instead of one row per window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so they can be inverted
_POSITION = _U((1 << 28) - 1)  # low bits of a run key: the position within a stretch of a text
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Bits of the table of repeated anchors: 16 MB, whatever the corpus.
TABLE_BITS = 27


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, extended as longer texts come."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 17)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                factors = np.full(size, b, _U)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _sums(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def _grams(values: np.ndarray, k: int, powers: _Powers) -> np.ndarray:
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    sums, down = _sums(values, powers)
    return mix((sums[k:] - sums[:-k]) * down[:n])


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k successive bytes."""
    return _grams(data.astype(_U) + _U(1), k, _BYTES)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    space = np.concatenate([[True], _SPACE[data], [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[::2], turns[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, down = _sums(data.astype(_U) + _U(1), _BYTES)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def word_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k successive words."""
    return _grams(hashes, k, _WORDS)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < width:
        values = np.minimum(values[: len(values) - (width - size)], values[width - size :])
    return values


class Runs(NamedTuple):
    anchor: np.ndarray  # the least m-gram's hash
    start: np.ndarray  # first window of the run
    count: np.ndarray  # windows of the run


def anchor_runs(grams: np.ndarray, width: int) -> Runs:
    """Runs of windows of ``width`` grams with one leftmost least gram."""
    if len(grams) < width:
        empty = np.zeros(0, np.int64)
        return Runs(np.zeros(0, _U), empty, empty)
    places = []
    # stretches of as many grams as positions fit, which overlap so that each window is in one of them
    size = int(_POSITION) + 1
    if size < width:
        raise ValueError(f"a window of {width} grams is longer than a stretch of {size}")
    for at in range(0, len(grams) - width + 1, size - width + 1):
        part = grams[at : at + size]
        # the position breaks ties to the left, at equal places in equal windows
        least = sliding_min((part & ~_POSITION) | np.arange(len(part), dtype=_U), width)
        places.append((least & _POSITION).astype(np.int64) + at)
    place = places[0] if len(places) == 1 else np.concatenate(places)
    starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    counts = np.diff(np.concatenate([starts, [len(place)]]))
    return Runs(grams[place[starts]], starts, counts)


def spread_runs(grams: np.ndarray, width: int) -> Runs:
    """``anchor_runs`` with anchors mixed once more.

    Least values are small ones: as they are they would share the first few slots of every table.
    """
    runs = anchor_runs(grams, width)
    return runs._replace(anchor=mix(runs.anchor))


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def repeated_anchors(texts: DataFrame, runs_of) -> DataFrame:
    """The anchors (column ``anchor``) of more than one run of ``texts`` (one text column ``text``).

    Tasks count by slices before anything is shuffled, so a passage of all documents is no hot key.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs_of(t.as_py()) for t in batch.column("text") if t.is_valid]
            anchors, counts = np.unique(np.concatenate([f.anchor for f in found] or [np.zeros(0, _U)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(anchors), pa.array(counts)], names=["anchor", "n"])

    counts = texts.select("text").mapInArrow(run, "anchor long, n long")
    return counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def anchor_table(spark: SparkSession, anchors: DataFrame):
    """A broadcast bit table of ``anchors``: of fixed size, so it may hold more, never less."""
    rows, width = 1 << 11, 1 << (TABLE_BITS - 11)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("anchor").to_numpy().view(_U) >> _U(64 - TABLE_BITS)
            for row in np.unique(slot // _U(width)):
                own = slot[slot // _U(width) == row] % _U(width)
                parts.setdefault(int(row), np.zeros(width, bool))[own.astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), pa.array([np.packbits(p).tobytes() for p in parts.values()], pa.binary())],
            names=["row", "bits"],
        )

    part = F.shiftrightunsigned("anchor", 64 - 11).cast("int")
    table = bytearray(rows * width // 8)
    dealt = anchors.repartition(32, part).mapInArrow(run, "row int, bits binary")
    for r in dealt.toLocalIterator():  # at most 2,048 rows of 8 kB
        table[r["row"] * width // 8 : (r["row"] + 1) * width // 8] = r["bits"]
    return spark.sparkContext.broadcast(bytes(table))


def in_table(table: bytes, anchors: np.ndarray) -> np.ndarray:
    slot = (anchors >> _U(64 - TABLE_BITS)).astype(np.int64)
    bits = np.frombuffer(table, np.uint8)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
