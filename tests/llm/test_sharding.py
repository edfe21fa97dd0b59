import zlib
from collections import Counter, defaultdict

from gristmill.llm.sharding import assign_shards

from .support import awkward, documents, empty


def test_slots_sizes_and_growth(spark):
    texts = [None if i % 50 == 0 else f"text é {i}" for i in range(3000)]
    rows = assign_shards(documents(spark, texts), [1.0] * 24).collect()
    assert len(rows) == 3000
    slots = defaultdict(list)
    for r in rows:
        text = texts[r.doc_id]
        assert r.size == 8 + len((text or "").encode())
        assert r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 60 < sum(r.grown_shard == 24 for r in rows) < 190


def test_weights_are_followed(spark):
    rows = assign_shards(documents(spark, ["x"] * 4000), [1.0, 3.0, 0.0]).collect()
    n = Counter(r.shard for r in rows)
    assert n[2] == 0 and 2.4 < n[1] / n[0] < 3.7


def test_removing_a_shard_moves_only_its_rows(spark):
    docs = documents(spark, ["x"] * 500)
    before = {r.doc_id: r.shard for r in assign_shards(docs, [1, 1, 1, 1]).collect()}
    after = {r.doc_id: r.shard for r in assign_shards(docs, [1, 0, 1, 1]).collect()}
    assert all(after[k] == s for k, s in before.items() if s != 1)


def test_odd_rows(spark):
    rows = assign_shards(awkward(spark), [1.0] * 3).collect()
    assert len(rows) == 9
    assert len({r.shard for r in rows if r.doc_id == 4}) == 1
    assert assign_shards(empty(spark), [1.0] * 3).count() == 0
