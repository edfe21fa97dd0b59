import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm.cuckoo import CuckooFilter, DigestIndex, _Part, copies_sql, exact_copies
from tests.llm.support import awkward, documents, empty

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(done):
    return sorted((tuple(r) for r in done.collect()), key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    pool = [f"text {rng.random()}" for _ in range(n // 2)] + ["hot " * 50] * (n // 2) + ["", None, "Straße", "Strasse", "a", "a "]
    return [rng.choice(pool) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"bits": 3, "start": 1}, {"digest": lambda t: F.pmod(F.crc32(t), F.lit(7))}])
def test_against_brute_force(spark, options):
    """Also with fingerprints of three bits and with digests that many texts share: hits are compared by content."""
    rows = list(enumerate(texts(1, 600)))
    docs = documents(spark, [(i, t) for i, t in rows], parts=5)
    done = exact_copies(docs, parts=4, **options)
    assert done.columns == COLUMNS
    assert got(done) == brute(rows)


def test_odd_rows(spark):
    docs = awkward(spark)
    assert got(exact_copies(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(exact_copies(empty(spark))) == []
    rows = [("b", "x" * 3_000_000), ("a", "x" * 3_000_000), (None, "y"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert got(exact_copies(docs)) == brute(rows)


def test_sql_twin(spark):
    rows = list(enumerate(texts(2, 300))) + [(None, "a"), (5, "a")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(copies_sql()).fetchall()
    assert got(exact_copies(documents(spark, rows))) == sorted(want, key=repr)


@pytest.mark.parametrize("options", [{}, {"bits": 4, "start": 1, "digest": lambda t: F.pmod(F.crc32(t), F.lit(40))}])
def test_batches_in_and_out(spark, options):
    index = DigestIndex(spark, parts=4, **options)
    batches = [[(b * 1000 + i, t) for i, t in enumerate(texts(b % 2, 120))] for b in range(3)]
    live = []
    for rows in batches:
        index.insert(documents(spark, rows))
        live += rows
        assert got(index.classes()) == brute(live)
    gone = [r for r in live if r[1] not in ("", None) and r[0] % 3] + [(99999, "never there"), (0, "other text")]
    index.delete(documents(spark, gone))
    live = [r for r in live if r not in gone]
    assert got(index.classes()) == brute(live)
    asked = [(-1, t) for t in {t for _, t in gone + live} | {"new text"}]
    known = {r.text_sha256 for r in index.contains(documents(spark, asked)).collect()}
    assert known == {x[4] for x in brute(live)}
    index.insert(documents(spark, gone))  # deleted texts may come back
    assert got(index.classes()) == brute(live + gone)
    index.delete(documents(spark, live + gone))
    assert got(index.classes()) == [] and index.contains(documents(spark, asked)).count() == 0
    index.insert(documents(spark, batches[0]))
    assert got(index.classes()) == brute(batches[0])


def test_compared_texts_stay_in_their_buckets(spark):
    index = DigestIndex(spark, parts=4)
    index.insert(documents(spark, texts(3, 200)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = spark.table(index.tables[0]).where("kind = 'hit'")
        plan = index._same_text(hits, "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan and "Join" in plan


def test_filter_finds_all_it_holds():
    rng = np.random.default_rng(1)
    digests = rng.integers(-(2**63), 2**63 - 1, size=3000).tolist()
    found = CuckooFilter(1024, 16)
    assert all(found.add(d) for d in digests)  # 73 % full
    assert all(d in found for d in digests)
    assert sum(int(d) in found for d in rng.integers(-(2**63), 2**63 - 1, size=20000)) < 30
    for d in digests[:1500]:
        found.discard(d)
    assert all(d in found for d in digests[1500:]) and sum(d in found for d in digests[:1500]) < 10
    again = CuckooFilter(1024, 16, np.frombuffer(found.to_bytes(), "<u4"))
    assert all(d in again for d in digests[1500:])


def test_overflow_builds_a_larger_filter():
    part = _Part(0, 16, 1)
    digests = list(range(-500, 500))
    for d in digests:
        part.add(d)
    assert part.filter.buckets >= 256 and all(d in part.filter for d in digests)
    few = _Part(0, 2, 1)  # three fingerprints cannot hold these digests, so they get longer
    for d in digests + [7] * 40:
        few.add(d)
    assert all(d in few.filter for d in digests)
    few.drop([7] * 40 + [8])
    assert 7 in few.filter and few.keys.count(7) == 1 and few.keys.count(8) == 0
