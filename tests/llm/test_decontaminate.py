import math
import os
import random
import re
import sys
from itertools import combinations

import duckdb

from gristmill.llm.decontaminate import AGREE, MASKS, SHORT, SHORT_MASKS, WINDOW, drop_leaks, find_leaks, leaks_sql

from .support import awkward, documents, empty

ITEMS = "item_id long, text string"
RNG = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)] + ["É", "the", "of"] * 20


def prose(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def by_hand(docs, items):
    """Every alignment that shares a seed; the best window around it."""
    out = {}
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for d, text in docs:
        mine = split(text)
        for i, item in items:
            theirs = split(item)
            need = min(len(theirs), WINDOW)
            for p in range(len(mine)):
                for q in range(len(theirs)):
                    for m in MASKS:
                        if p + m[-1] >= len(mine) or q + m[-1] >= len(theirs):
                            continue
                        if any(mine[p + k] != theirs[q + k] for k in m):
                            continue
                        back = min(p, q, WINDOW - 1)
                        ahead = min(len(mine) - p, len(theirs) - q, 9 + WINDOW)
                        for s in range(-back, ahead - need + 1):
                            n = sum(mine[p + s + j] == theirs[q + s + j] for j in range(need))
                            if n >= need * AGREE - 1e-9:
                                a, b = out.get((d, i), (0, 0))
                                out[d, i] = max((a, b), (n, -p))
    return {k: (n, -p) for k, (n, p) in out.items()}


def case():
    items = [(1, " ".join(prose(30))), (2, " ".join(prose(15))), (3, "too short here"), (4, None), (5, "")]
    texts = [" ".join(prose(120)) for _ in range(6)]
    for n, (item, changed) in enumerate([(0, 0), (0, 4), (1, 3), (1, 0), (0, 14)]):
        passage = items[item][1].split()
        for at in RNG.sample(range(len(passage)), changed):
            passage[at] = "changed"
        words = prose(60)
        texts.append(" ".join(words[:n * 10] + passage + words[n * 10 :]))
    return list(enumerate(texts)), items


def test_against_brute_force_and_sql(spark, tmp_path):
    docs, items = case()
    frame, bench = documents(spark, [t for _, t in docs]), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id): (r.n_equal, r.first_word) for r in find_leaks(frame, bench).collect()}
    assert got == by_hand(docs, items)
    assert {(6, 1), (7, 1), (8, 2), (9, 2)} <= set(got)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    rows = con.execute(leaks_sql()).fetchall()
    assert {(d, i): (n, p) for d, i, n, _, p in rows} == got


def test_odd_rows(spark):
    item = " ".join(prose(20))
    bench = spark.createDataFrame([(1, item), (2, item), (3, None)], ITEMS)
    docs = documents(spark, [(7, item), (7, item), (None, item), (8, None), (9, "other words")])
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()} == {(7, 1), (7, 2), (None, 1), (None, 2)}
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [8, 9]
    assert find_leaks(awkward(spark), bench).count() == 0
    assert drop_leaks(awkward(spark), bench).count() == 9
    assert find_leaks(empty(spark), bench).count() == 0
    assert find_leaks(docs, bench.where("item_id > 5")).count() == 0


def test_no_python_in_the_plan(spark):
    docs, items = case()
    plan = find_leaks(documents(spark, [t for _, t in docs]), spark.createDataFrame(items, ITEMS))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_allowed_substitutions_leave_a_seed():
    for n in range(3, WINDOW + 1):
        masks = (*MASKS, *SHORT_MASKS) if n <= SHORT else MASKS
        allowed = n - math.ceil(n * AGREE)
        seeds = [{at + k for k in m} for m in masks for at in range(n - m[-1])]
        lost = [places for places in combinations(range(n), allowed) if all(s & set(places) for s in seeds)]
        assert not lost, (n, lost)


def test_short_items_against_brute_force_without_seeds(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(3, SHORT + 1)]
    texts = []
    for n, item in items:
        allowed = n - math.ceil(n * AGREE)
        for changed in range(allowed + 2):
            for places in combinations(range(n), changed):
                passage = [f"changed{k}" if k in places else w for k, w in enumerate(item.split())]
                texts.append(" ".join(prose(4) + passage + prose(len(texts) % 4)))
        texts.append(" ".join(item.split()[1:]))  # the item is not whole
    want = {}
    for d, text in enumerate(texts):
        mine = text.lower().split()
        for i, item in items:
            theirs = item.split()
            starts = range(len(mine) - len(theirs) + 1)
            best = max((sum(a == b for a, b in zip(mine[s:], theirs)) for s in starts), default=0)
            if best >= len(theirs) * AGREE - 1e-9:
                want[d, i] = (best, len(theirs))
    bench = spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_compared) for r in find_leaks(documents(spark, texts), bench).collect()}
    assert got == want
