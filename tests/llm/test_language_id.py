import random
import zlib

import numpy as np

from gristmill.llm.language_id import BUCKETS, Model, family, fit_svm, language_id, learn, ngrams

from .support import DOCS, awkward, empty

RNG = random.Random(2)
PIECES = {
    "en": "the ing and wh sh tion ough er of th".split(),
    "de": "sch und ich die ung ein ü ß keit zu".split(),
    "es": "ción ar de la que ñ os mente ll el".split(),
    "fr": "eau le ment qu é ê oui de ai ç".split(),
    "xx": "zq kvk xoo wub jj".split(),
}


def text(lang, n=60):
    return " ".join("".join(RNG.choice(PIECES[lang]) for _ in range(RNG.randint(1, 3))) for _ in range(n))


def corpus(n=600):
    return [(i, text(lang), lang, "s", 0) for i in range(n) for lang in [list(PIECES)[i % 5]]]


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = {r.doc_id: r for r in language_id(docs).collect()}
    assert len(found) == len(rows)
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(found[i].held_out == (i in set(held)) for i in found)
    right = [found[i].lang_pred == rows[i][2] for i in held]
    assert np.mean(right) >= 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_case_and_long_texts_and_und(spark):
    rows = corpus() + [
        (9000, text("de").upper(), None, None, None), (9001, text("fr", 20_000), None, None, None),
        (9002, None, "en", None, None), (9003, "", "en", None, None), (9004, "12 +- 34 \n", "de", None, None),
        (None, text("es"), None, None, None), (9005, "ß", None, None, None),
    ]
    found = {r.doc_id: r for r in language_id(spark.createDataFrame(rows, DOCS)).collect()}
    assert (found[9000].lang_pred, found[9001].lang_pred, found[None].lang_pred) == ("de", "fr", "es")
    assert [found[i].lang_pred for i in (9002, 9003, 9004)] == ["und"] * 3
    assert found[9005].lang_pred in PIECES


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = corpus(200)
    turned = [(i, t, "en" if zlib.crc32(str(i).encode()) % 4 == 2 else n, s, c) for i, t, n, s, c in rows]
    a, b = (learn(spark.createDataFrame(x, DOCS)) for x in (rows, turned))
    assert np.array_equal(a.weights, b.weights)


def test_model_parts():
    assert family("es") == family("fr") != family("de") and family("zz") == "only zz"
    assert ngrams("Abc É").max() < BUCKETS and (ngrams("abc") == ngrams("ABC!")).all()
    x = np.random.default_rng(0).normal(size=(200, 5))
    w = fit_svm(x, np.where(x[:, 0] + x[:, 1] > 0, 1.0, -1.0))
    assert ((x @ w[:-1] + w[-1] > 0) == (x[:, 0] + x[:, 1] > 0)).mean() > 0.95
    assert Model(np.zeros((0, BUCKETS), np.float32), []).predict("abc") == ("und", 0.0)
    one = Model(np.ones((2, BUCKETS), np.float32), ["en", "en"])
    assert one.predict("abc")[0] == "en"


def test_odd_rows(spark):
    assert len(language_id(awkward(spark)).collect()) == 9
    assert language_id(empty(spark)).count() == 0
