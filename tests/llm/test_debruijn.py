import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import rolling
from gristmill.llm.debruijn import cut_repeats, remove_repeats, repeated_spans

from .support import awkward, documents, empty

RNG = random.Random(4)


def by_hand(texts, k):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def run(spark, texts, k, m):
    rows = remove_repeats(documents(spark, texts), k, m).collect()
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    return [found[i] for i in range(len(texts))]


def prose(n, vocab=200):
    return [f"w{RNG.randrange(vocab)}é" for _ in range(n)]


def test_against_brute_force(spark):
    passages = [prose(n) for n in (12, 25, 40)]
    texts = []
    for i in range(120):
        words = prose(RNG.randint(0, 60), 3 if i % 10 == 0 else 200)
        if i % 3 == 0:
            at, p = RNG.randint(0, len(words)), RNG.choice(passages)
            a = RNG.randint(0, 3)
            words[at:at] = p[a : len(p) - RNG.randint(0, 3)]
        texts.append(RNG.choice([" ", "  ", "\n"]).join(words))
    texts += ["same " * 50, "a b " * 30, texts[5], texts[5], None, "", " x y\x0bz", " ".join(passages[2])]
    assert run(spark, texts, 10, 4) == by_hand(texts, 10)
    assert run(spark, texts, 35, 12) == by_hand(texts, 35)


def test_one_passage_in_most_texts(spark):
    passage = " ".join(prose(20))
    texts = [" ".join(prose(15)) + " " + passage + " " + " ".join(prose(15)) for _ in range(200)]
    assert run(spark, texts, 10, 4) == by_hand(texts, 10)


def test_paths_are_compact(spark):
    passage = prose(300, 10**6)
    texts = [" ".join(prose(20, 10**6) + passage + prose(20, 10**6)) for _ in range(5)]
    spans = repeated_spans(documents(spark, texts)).collect()
    runs = {(r.start, r["count"]) for r in spans}
    # the passage is one path; the ten runs that reach out of it end in a piece each
    assert len({r.path for r in spans}) <= 11 and len(runs) > 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_sliding_min_and_runs(values, width):
    grams = rolling.mix(np.array(values, dtype=np.uint64) + np.uint64(1))
    runs = rolling.anchor_runs(grams, width)
    at = 0
    for anchor, start, count in zip(*runs):
        assert start == at
        for w in range(start, start + count):
            assert grams[w : w + width].min() >> np.uint64(28) == anchor >> np.uint64(28)
        at += count
    assert at == max(0, len(values) - width + 1)


def test_cut_keeps_columns_and_clean_rows(spark):
    passage = " ".join(prose(40, 10**6))
    docs = documents(spark, ["alone  in\nhere", passage, "before " + passage + " after", None])
    rows = {r.doc_id: r.text for r in cut_repeats(docs).collect()}
    assert rows == {0: "alone  in\nhere", 2: "before after", 3: None}
    assert cut_repeats(docs).columns == docs.columns


def test_odd_rows(spark):
    rows = remove_repeats(awkward(spark), 10, 4).collect()
    assert len(rows) == 9
    assert {r.doc_id: r.n_removed for r in rows}[3] == 3000
    assert remove_repeats(empty(spark)).count() == 0
    assert cut_repeats(awkward(spark)).columns == awkward(spark).columns


def test_runs_of_a_text_with_more_grams_than_positions(monkeypatch):
    rng = np.random.default_rng(5)
    grams, width = rng.integers(0, 1 << 63, 1000, dtype=np.uint64), 10
    grams[300:400] = grams[280]  # ties
    monkeypatch.setattr(rolling, "_POSITION", np.uint64((1 << 6) - 1))
    high = grams >> np.uint64(6)
    place = [i + int(np.argmin(high[i : i + width])) for i in range(len(grams) - width + 1)]
    starts = [i for i, p in enumerate(place) if i == 0 or p != place[i - 1]]
    runs = rolling.anchor_runs(grams, width)
    assert runs.start.tolist() == starts
    assert runs.count.tolist() == np.diff([*starts, len(place)]).tolist()
    assert runs.anchor.tolist() == [int(grams[place[i]]) for i in starts]


def test_spread_runs_fill_tables_evenly():
    """Anchors are least hashes; mixed, as many fall into the upper half of the values as into the lower."""
    grams = rolling.byte_grams(np.random.default_rng(3).integers(97, 123, 200_000).astype(np.uint8), 64)
    plain, spread = rolling.anchor_runs(grams, 137), rolling.spread_runs(grams, 137)
    assert spread.start.tolist() == plain.start.tolist() and spread.count.tolist() == plain.count.tolist()
    assert len(np.unique(spread.anchor)) == len(np.unique(plain.anchor))
    assert (plain.anchor >> np.uint64(63)).sum() == 0
    assert abs((spread.anchor >> np.uint64(63)).mean() - 0.5) < 0.05
