"""Language identification: the family first, then one-versus-one support vector machines within it.

All classifiers are linear in the shares of hashed letter n-grams, so a text of any length is scored
by summing one row of weights per n-gram.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import cut, learn_fold

SAMPLE = 4_000  # documents that the classifiers are fitted on, at most, shared evenly by the languages
BUCKETS = 4_096
_LETTER = re.compile(r"[^\W\d_]")

# Families of common languages; a language not named here is a family of its own.
FAMILIES = {
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "turkic": ("az", "kk", "tr", "uz"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

# ASCII upper case to lower case, everything that is no letter to a space
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang, f"only {lang}")


def ngrams(text: str) -> np.ndarray:
    """Buckets of all 2- and 3-grams of the UTF-8 bytes of the lower-cased letters, words set off by spaces."""
    plain = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" "
    b = np.frombuffer(plain, np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    codes = np.concatenate([two, three + np.uint32(1 << 24)])
    return (codes * np.uint32(2_654_435_761)) >> np.uint32(20)  # 12 bits: BUCKETS


def _shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The language and the n-gram shares of each text that has a letter, as 16-bit floats."""
    for batch in batches:
        langs, rows = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            if _LETTER.search(text):
                grams = ngrams(text)
                counts = np.bincount(grams, minlength=BUCKETS) / len(grams)
                rows.append((1000 * counts).astype(np.float16).tobytes())
                langs.append(lang)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "shares"]
        )


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, passes: int = 60) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge, classes weighted alike).

    ``y`` is +1 or -1.  Accelerated gradient descent; features are scaled to unit deviation first and
    the scale is folded into the weights.
    """
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-2
    z = np.empty((len(x), x.shape[1] + 1), np.float32)  # the only copy of the features
    np.subtract(x, mean.astype(np.float32), out=z[:, :-1])
    z[:, :-1] /= scale.astype(np.float32)
    z[:, -1] = 1
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    w = look = np.zeros(z.shape[1], np.float32)
    # the largest curvature, by a few power steps
    v = np.full(z.shape[1], 1 / np.sqrt(z.shape[1]), np.float32)
    for _ in range(8):
        v = z.T @ (share * (z @ v))
        v /= np.linalg.norm(v) + np.float32(1e-12)
    rate = np.float32(1 / (2 * v @ (z.T @ (share * (z @ v))) * 1.2 + ridge))
    for step in range(passes):
        slack = np.maximum(0, 1 - y * (z @ look))
        gradient = -2 * (z.T @ (share * y * slack)) + np.float32(ridge) * look
        new = look - rate * gradient
        look = new + np.float32(step / (step + 3)) * (new - w)
        w = new
    weights = w[:-1] / scale
    return np.append(weights, w[-1] - mean @ weights)


def sides(langs: list[str]) -> tuple[list[str], list[list[str]], list[list[tuple[str, str, int]]], list[dict[str, float]]]:
    """Families, their members, the pairs of members with their column, and per column the side of each language.

    The first columns part one family from the rest, the others two languages of a family; languages
    that a column does not part have no side there.
    """
    families = sorted({family(n) for n in langs})
    members = [[n for n in langs if family(n) == f] for f in families]
    columns = [{n: 1.0 if family(n) == f else -1.0 for n in langs} for f in families]
    pairs: list[list[tuple[str, str, int]]] = []
    for own in members:
        pairs.append([])
        for a, b in combinations(own, 2):
            pairs[-1].append((a, b, len(columns)))
            columns.append({a: 1.0, b: -1.0})
    return families, members, pairs, columns


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return fit_svm(x, y) if (y > 0).any() and (y < 0).any() else np.zeros(x.shape[1] + 1)


def _fit_group(rows: pd.DataFrame) -> pd.DataFrame:
    """One column of weights from the vectors on its two sides, in an order of their own."""
    rows = rows.sort_values(["lang", "shares"], kind="stable")
    x = np.empty((len(rows), BUCKETS), np.float32)
    for i, shares in enumerate(rows["shares"]):
        x[i] = np.frombuffer(shares, np.float16)
    found = _fitted(x, rows["side"].to_numpy())
    return pd.DataFrame({"number": [int(rows["number"].iloc[0])], "weights": [found.astype("<f8").tobytes()]})


class Model:
    """Columns of weights: one per family (one against the rest), then one per pair within a family.

    ``columns`` are those of ``sides``; without them they are fitted here from the vectors ``x``.
    """

    def __init__(self, x: np.ndarray | None, langs: list[str], columns: list[np.ndarray] | None = None) -> None:
        self.langs = sorted(set(langs))
        self.families, self.members, self.pairs, parted = sides(self.langs)
        if columns is None:
            columns = []
            for side in parted:
                rows = np.array([n in side for n in langs])
                columns.append(_fitted(x[rows], np.array([side[n] for n in langs if n in side])))
        table = np.array(columns, dtype=np.float32).T if columns else np.zeros((BUCKETS + 1, 0), np.float32)
        self.weights, self.bias = np.ascontiguousarray(1000 * table[:-1]), table[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how sure it is, from 0 to 1; ``und`` without a letter or without a model."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        counts = np.bincount(ngrams(text), minlength=BUCKETS)
        margins = (counts @ self.weights) / counts.sum() + self.bias
        best = int(np.argmax(margins[: len(self.families)]))
        sure = 1.0
        if len(self.families) > 1:
            sure = _sigmoid(margins[best])
        members = self.members[best]
        votes = dict.fromkeys(members, 0)
        total = dict.fromkeys(members, 0.0)
        for a, b, column in self.pairs[best]:
            votes[a if margins[column] >= 0 else b] += 1
            total[a] += margins[column]
            total[b] -= margins[column]
        lang = max(members, key=lambda n: (votes[n], total[n], n))
        if len(members) > 1:
            sure *= _sigmoid(total[lang] / (len(members) - 1))
        return lang, float(sure)


def _sigmoid(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * margin, -30, 30))))


def learn(docs: DataFrame, rows: int = SAMPLE) -> Model:
    """Fit on at most ``rows`` documents with a language, outside the held-out fold.

    Each language gives the same number, those with the smallest id hashes.  Their vectors (8 kB each,
    32 MB at the default) stay in the shared folder; every column of weights is fitted in a task of its
    own, and the driver gets 4,097 numbers of each.
    """
    spark = docs.sparkSession
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~learn_fold("doc_id", 4, 2))
    ids = named.select("doc_id", "lang")
    langs = ids.select("lang").distinct().count()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    each = max(1, rows // max(1, langs))
    chosen = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("doc_id", "lang")
    chosen = cut(chosen.distinct())
    sample = named.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    # rows that repeat an id may exceed the bound; they are cut in the same order
    got = cut(sample.mapInArrow(_shares, "lang string, shares binary").orderBy(F.xxhash64("shares")).limit(rows))
    found = sorted(r["lang"] for r in got.select("lang").distinct().collect())
    parted = sides(found)[3]
    if not parted:
        return Model(None, found, [])
    items = spark.createDataFrame([(k, n, side) for k, of in enumerate(parted) for n, side in of.items()], "number int, lang string, side double")
    groups = got.join(items, "lang").groupBy("number")  # a group holds ``rows`` vectors at most
    columns = {r["number"]: np.frombuffer(r["weights"], "<f8") for r in groups.applyInPandas(_fit_group, "number int, weights binary").collect()}
    return Model(None, found, [columns[k] for k in range(len(parted))])


def _predictor(model: Model):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [model.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["lang", "score"],
            )

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang string, score double").asNondeterministic()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document; only the text is read for them, and read whole.

    Null texts and texts without a letter are ``und`` with score 0, as is every text when no labelled
    document was there to learn from; rows are predicted one by one, so repeated rows agree; ties go
    to the later code; null ids stay; an empty table gives no rows; other columns are ignored.
    """
    found = docs.select("doc_id", _predictor(model)("text").alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` and predict all of them; ``held_out`` marks the fold that was not learnt from."""
    found = identify(docs, learn(docs))
    return found.select("doc_id", learn_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
