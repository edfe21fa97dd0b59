import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm.toxicity import Trie, _quoted, _Weights, drop_toxic, features, learn, score, toxicity

from .support import awkward, documents, empty

LABELS = "doc_id long, quality int, toxic int"
RNG = random.Random(11)
BAD = ["grumblic", "snorvex", "plodmire"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abc", min_size=5, max_size=8), min_size=1, max_size=5), st.text("abc", max_size=10))
def test_fuzzy_is_distance_one(terms, word):
    trie = Trie([(t, False, 2.0) for t in terms], terms)
    assert bool(trie.fuzzy(word)[0]) == any(distance(t, word) <= 1 for t in terms)


def test_words_and_stems():
    trie = Trie([("abcde", False, 3.0), ("xyzu", True, 2.0)], ["abcde"])
    assert (trie.exact("abcde"), trie.exact("abcdef"), trie.exact("xyzuvw"), trie.exact("xyz")) == (3.0, 0, 2.0, 0)
    assert trie.fuzzy("abdde") == (3.0, "abcde") and trie.fuzzy("xyzuq") == (0.0, "")


def test_quotation_is_told_from_abuse():
    weights = _Weights(Trie([("snorvex", False, 5.0)], []))
    text = 'They wrote "you snorvex" in a letter'
    assert _quoted(text, text.index("snorvex")) and not _quoted(text, text.index("letter"))
    assert _quoted("er sagte: „du snorvex“ und ging", 14)
    assert all(a < b for a, b in zip(features(text, weights), features(text.replace('"', ""), weights)))


def corpus():
    texts, labels = [], []
    for i in range(400):
        words = [RNG.choice("river stone cloud paper green".split()) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[RNG.randrange(40)] = RNG.choice(BAD)
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return texts, labels


def test_learns_scores_and_catches_misspellings(spark):
    texts, labels = corpus()
    plain = " ".join(["river stone cloud"] * 12)
    texts += [plain + " snorvvex grumblik plodnire snorvx", plain + " you", None, ""]
    docs, marks = documents(spark, texts), spark.createDataFrame(labels, LABELS)
    rows = {r.doc_id: r for r in toxicity(docs, marks).collect()}
    assert len(rows) == len(texts)
    assert all(rows[i].predicted == toxic for i, _, toxic in labels)
    assert rows[400].predicted == 1 and [rows[i].predicted for i in (401, 402, 403)] == [0, 0, 0]
    assert all(0 <= r.score <= 1 for r in rows.values())
    kept = drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}
    model = learn(docs, marks)
    assert set(BAD) <= set(model.fuzzy) and len(score(docs, model).columns) == len(docs.columns) + 1


def test_held_out_labels_are_not_read(spark):
    import zlib

    texts, labels = corpus()
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    docs = documents(spark, texts)
    a, b = (learn(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert a.lexicon == b.lexicon and np.allclose(a.weights, b.weights)


def test_odd_rows(spark):
    texts, labels = corpus()
    marks = spark.createDataFrame([*labels[:3], (None, 1, 1), (4, None, None), (4, 1, 0), (4, 1, 0)], LABELS)
    rows = toxicity(awkward(spark), marks).collect()
    assert len(rows) == 9 and all(r.predicted == 0 and r.score == 0 for r in rows)
    assert drop_toxic(awkward(spark), marks).count() == 9
    assert toxicity(empty(spark), spark.createDataFrame([], LABELS)).count() == 0


def test_misspellings_of_a_word_that_a_stem_covers(spark):
    texts, labels = corpus()
    spoiled = [i for i, _, toxic in labels if toxic]
    for i in spoiled:
        texts[i] = texts[i].replace("snorvex", "snorvexy" if i == spoiled[0] else "snorvex") + " snorvex"
    for i in spoiled[1:8]:  # an inflected form alone, so that the stem has more documents than the word
        texts[i] = texts[i].replace("snorvex", "snorvexing")
    docs, marks = documents(spark, texts), spark.createDataFrame(labels, LABELS)
    model = learn(docs, marks)
    assert "snorvex" not in {t for t, stem, _ in model.lexicon if not stem}
    assert "snorvex" in model.fuzzy
    weights = _Weights(Trie(model.lexicon, model.fuzzy))
    assert weights["snorvex"] > 0 and all(weights[w] < 0 for w in ("snnorvex", "norvex", "xnorvex", "sxorvex"))
    plain = " ".join(["river stone cloud"] * 12)
    rows = score(documents(spark, [plain + " snnorvex norvex xnorvex sxorvex", plain]), model).collect()
    assert {r.doc_id: r.toxicity >= 0.5 for r in rows} == {0: True, 1: False}
