import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gristmill.llm.encoding import DEFAULT, encoder
from gristmill.llm.packing import pack, plan_bins
from gristmill.llm.token_counts import CACHE_SCHEMA, count_tokens

from .support import awkward, documents, empty

LIBRARY = Tokenizer.from_file(public_tokenizers.path(DEFAULT))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="ab é'sß \n\t.,1½²<|endoftext>“”€ª", max_size=60)))
def test_ids_are_the_librarys(text):
    assert encoder().ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_counts_and_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    texts = ["a b c", "a b c", None, "", "word " * 1100, "<|endoftext|>x"]
    rows = {r.doc_id: r for r in count_tokens(documents(spark, texts), cache).collect()}
    for i, text in enumerate(texts):
        n = len(LIBRARY.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((text or "").encode()), n > 1024)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    assert stored.count() == 4  # null and empty are one content
    # what is stored is used, not encoded anew, and only new contents are appended
    odd = stored.select("version", "digest", (stored.n_tokens + 1000).alias("n_tokens")).collect()
    other = str(tmp_path / "other")
    spark.createDataFrame(odd, CACHE_SCHEMA).write.parquet(other)
    rows = {r.doc_id: r.n_tokens for r in count_tokens(documents(spark, ["a b c", "new"]), other).collect()}
    assert rows == {0: 1003, 1: 1}
    assert spark.read.parquet(other).count() == 5


def test_counts_of_odd_rows(spark, tmp_path):
    rows = count_tokens(awkward(spark), str(tmp_path / "cache")).collect()
    assert len(rows) == 9 and all(r.n_tokens is not None for r in rows)
    assert count_tokens(empty(spark), str(tmp_path / "none")).count() == 0


def lay_out(places):
    bins = defaultdict(list)
    for p in places:
        for i in range(p.count):
            bins[p.bin + i // p.each].append((p.offset + i % p.each * p.length, p.length))
    return bins


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 30), max_size=12))
def test_plan_places_everything(histogram):
    bins = lay_out(plan_bins(histogram, 24))
    seen = defaultdict(int)
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
            seen[length] += 1
        assert end <= 24
    assert dict(seen) == histogram
    assert sorted(bins) == list(range(len(bins)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=40))
def test_plan_equals_piece_by_piece_best_fit(lengths):
    """The same greedy rules, one piece at a time."""
    rooms, left = [], sorted((n for n in lengths if 3 * n > 24), reverse=True)
    while left:
        x = left.pop(0)
        fits = [y for y in left if x + y <= 24]
        if fits:
            left.remove(fits[0])
        rooms.append(24 - x - (fits[0] if fits else 0))
    for n in sorted((n for n in lengths if 3 * n <= 24), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(24 - n)
    histogram = {n: lengths.count(n) for n in set(lengths)}
    bins = lay_out(plan_bins(histogram, 24))
    assert sorted(24 - sum(n for _, n in b) for b in bins.values()) == sorted(rooms)


def test_pack_round_trip(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab the of nation".split()) for _ in range(rng.randint(0, 150))) for _ in range(400)]
    texts += ["word " * 500, None, "", "word " * 500]
    docs = documents(spark, texts)
    rows = pack(docs, capacity=64).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 64)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for content in by_bin.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by_bin) <= 1.03 * sum(r.length for r in rows) / 64 + 1


def test_pack_odd_rows(spark):
    rows = pack(awkward(spark)).collect()
    assert sum(r.piece == 0 for r in rows) == 9
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert pack(empty(spark)).count() == 0


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        plan_bins({65: 1}, 64)
