import random

from gristmill.llm.components import components
from gristmill.llm import jaccard_join
from gristmill.llm.jaccard_join import keep_one, near_copies, prefix_depth

from .support import awkward, documents, empty

RNG = random.Random(9)


def grams(text, k=5):
    words = (text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def by_hand(texts, threshold=0.8):
    sets = [grams(t) for t in texts]
    near = lambda a, b: bool(a) and bool(b) and len(a & b) >= threshold * len(a | b)
    links = [[j for j, b in enumerate(sets) if j != i and near(a, b)] for i, a in enumerate(sets)]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(links):
            low = min([label[i], *(label[j] for j in js)])
            for x in (i, *js):
                if label[x] != low:
                    label[x], changed = low, True
    return [(label[i], len(js), sum(sets[j] == sets[i] for j in js)) for i, js in enumerate(links)]


def prose(n):
    return [f"w{RNG.randrange(500)}" for _ in range(n)]


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        words[RNG.randrange(len(words))] = "edit"
    return " ".join(words)


def corpus():
    bases = [prose(n) for n in (30, 80, 150)]
    texts = [edited(RNG.choice(bases), RNG.randint(0, 5)) for _ in range(150)]
    texts += [" ".join(prose(40)) for _ in range(40)]
    texts += [texts[0]] * 5 + ["a b", "a b", "a  b", "a", None, "", " \n"]
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    rows = near_copies(documents(spark, texts)).collect()
    found = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in rows}
    assert [found[i] for i in range(len(texts))] == by_hand(texts)


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    base = prose(200)
    texts = [edited(base, RNG.randint(0, 6)) for _ in range(120)]
    rows = near_copies(documents(spark, texts)).collect()
    found = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in rows}
    assert [found[i] for i in range(len(texts))] == by_hand(texts)


def test_one_of_each_group_stays(spark):
    texts = corpus()
    docs = documents(spark, texts)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for c, _, _ in by_hand(texts)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    again = documents(spark, [(7, "x y z"), (7, "x y z"), (None, "x y z"), (None, "p q"), (None, "p q")])
    assert sorted((r.doc_id or 0, r.text) for r in keep_one(again).collect()) == [(0, "p q"), (7, "x y z")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (100, 100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_depth():
    depth = prefix_depth()
    assert 1 - (1 - 0.8**depth) ** 24 >= 0.99999 > 1 - (1 - 0.8 ** (depth + 1)) ** 24


def test_odd_rows(spark):
    rows = near_copies(awkward(spark)).collect()
    assert len(rows) == 9
    assert sorted(r.n_links for r in rows if r.doc_id in (4, 5)) == [2, 2, 2]
    assert {r.doc_id for r in keep_one(awkward(spark)).collect()} == {1, 2, 3, 4, 6, 7, None}
    assert near_copies(empty(spark)).count() == 0 and keep_one(empty(spark)).count() == 0
