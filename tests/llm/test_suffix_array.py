import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import rolling, suffix_array
from gristmill.llm.suffix_array import _steps, remove_repeats, sorted_repeats

from .support import awkward, documents, empty

RNG = random.Random(8)


def by_hand(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = [False] * (len(d) + 1)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone[:-1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, n, m):
    rows = remove_repeats(documents(spark, texts), n, m).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    return [found[i] for i in range(len(texts))]


def prose(n):
    return " ".join("".join(RNG.choice("aeioué") + RNG.choice("bcdfgh") for _ in range(3)) for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=70), min_size=1, max_size=6), st.integers(11, 60))
def test_sort_of_a_group(texts, length):
    bodies = [t.encode() for t in texts if len(t) >= length] or [b"a" * length]
    copies = np.array([1 + (i % 3 == 2) for i in range(len(bodies))])
    counts = np.array([len(b) - length + 1 for b in bodies])
    seen = Counter()
    for b, c in zip(bodies, copies):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += c
    want = [seen[b[i : i + length]] > 1 for b in bodies for i in range(len(b) - length + 1)]
    assert sorted_repeats(bodies, counts, copies, length).tolist() == want


@pytest.mark.parametrize("group", [suffix_array.GROUP, 0])
def test_against_brute_force(spark, group, monkeypatch):
    """In tasks, and (as if every group were too large for one) by Spark."""
    monkeypatch.setattr(suffix_array, "GROUP", group)
    passages = [prose(n) for n in (6, 12, 30)]
    texts = []
    for i in range(60):
        t = prose(RNG.randint(0, 25))
        if i % 2:
            p, at = RNG.choice(passages), RNG.randint(0, len(t))
            t = t[:at] + p[RNG.randint(0, 9) : len(p) - RNG.randint(0, 9)] + t[at:]
        texts.append(t)
    texts += ["ab" * 80, "x" * 90, texts[3], texts[3], None, "", "é" * 60]
    assert run(spark, texts, 40, 12) == by_hand(texts, 40)


def test_full_length(spark):
    passages = [prose(n) for n in (29, 45)]
    texts = [prose(RNG.randint(0, 10)) + p[RNG.randint(0, 4) :] + prose(5) for p in passages for _ in range(5)]
    assert run(spark, texts, 200, 64) == by_hand(texts, 200)


def test_sizes():
    for length in range(30, 400):
        a, b, reach = _steps(length)
        assert 0 < a < b < reach == length - 3 and (b - a) % 6 == (reach - b) % 6 == 0
        assert 3 * a >= b and 3 * b >= reach  # three names leave no gap


def test_odd_rows(spark):
    rows = {r.doc_id: r for r in remove_repeats(awkward(spark), 40, 12).collect()}
    assert len(rows) == 8 and rows[3].n_removed == 15_000 and rows[6].n_removed == 5000 and rows[1].n_bytes == 0
    assert remove_repeats(empty(spark)).count() == 0


def _bits(keys):
    table = np.zeros(1 << rolling.TABLE_BITS, bool)
    table[(keys >> np.uint64(64 - rolling.TABLE_BITS)).astype(np.int64)] = True
    return SimpleNamespace(value=np.packbits(table).tobytes())


def test_bodies_of_sources_only(monkeypatch):
    """A run that a text holds twice is given once, and texts that are no source are not searched."""
    passage = prose(20)
    texts = [passage + prose(9) + passage, prose(30), passage]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([1, 2, 3]), pa.array(texts)], names=["k1", "k2", "text"])
    runs_of, searched = suffix_array._runs_of(40, 12), []
    runs = runs_of(texts[0])
    body = [texts[0].encode()[x : x + n + 39] for x, n in zip(runs.start, runs.count)]
    at = next(i for i, b in enumerate(body) if body.count(b) == 2)
    keys = suffix_array._source_key(np.array([7, 7]), np.array([-1, runs.start[at]]))
    monkeypatch.setattr(suffix_array, "_runs_of", lambda *_: lambda t: searched.append(t) or runs_of(t))
    rows = list(suffix_array._open_runs(_bits(runs.anchor), 40, 12, _bits(keys))([batch]))
    rows = [r for b in rows for r in b.to_pylist()]
    assert [(r["k1"], r["k2"], r["start"], r["body"]) for r in rows] == [(7, 1, runs.start[at], body[at])]
    assert searched == [texts[0]]
