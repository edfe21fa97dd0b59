"""Toxicity scores from a learned lexicon, fuzzy word lookup and the context of each hit.

The lexicon (words, and stems that begin words) and the weights are learned from labelled documents.
Words of a text meet the lexicon's trie through a Levenshtein automaton, so misspelled terms count
too; hits inside quotation marks count less; windows of words around the hits decide, together with
their number, between a passing mention and abuse.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, learn_fold, slices, written

SAMPLE = 8_000  # labelled documents that the lexicon and the weights are fitted on, at most
LEXICON = 300  # terms kept
STEM = (4, 8)  # letters of a stem
LEAST_DOCS = 5  # toxic documents a term must occur in
LEAST_SHARE = 0.7  # of a term's documents that must be toxic, each class weighted alike
FUZZY_FROM = 5  # letters from which one error is allowed
FUZZY_CLEAN = 0.002  # share of clean documents that near misses of such a term may occur in
MISSPELLED = 0.7  # what a misspelled hit counts
WINDOW = 12  # words of a context window
QUOTED = 0.3  # what a hit inside quotation marks counts

_WORD = re.compile(r"\w+")
_OPEN, _CLOSE = "“«„‹", "”»“›"
N_FEATURES = 5


class Trie:
    """Lexicon terms by their letters; a node may end a word, a stem, or both."""

    def __init__(self, terms: Iterable[tuple[str, bool, float]], fuzzy: Iterable[str]) -> None:
        self.root: dict = {}
        self.longest = 0
        heads, tails = set(), set()
        for term, stem, weight in terms:
            node = self._node(term)
            mark = "stem" if stem else "word"
            node[mark] = max(weight, node.get(mark, 0.0))
        for term in set(fuzzy):  # weighs what its right spelling does, by itself or by a stem
            self._node(term)["fuzzy"] = (self.exact(term), term)
            self.longest = max(self.longest, len(term))
            heads.add(term[:2])
            tails.add(term[-2:])
        self.heads, self.tails = frozenset(heads), frozenset(tails)

    def _node(self, term: str) -> dict:
        node = self.root
        for c in term:
            node = node.setdefault(c, {})
        return node

    def exact(self, word: str) -> float:
        """The best weight of the word itself or of a stem that begins it."""
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            best = max(best, node.get("stem", 0.0))
        return max(best, node.get("word", 0.0))

    def fuzzy(self, word: str) -> tuple[float, str]:
        """The weightiest term that is one insertion, deletion or substitution away, with its weight."""
        return max(self.near(word), default=(0.0, ""))

    def near(self, word: str) -> list[tuple[float, str]]:
        """Weight and term of all terms that are one insertion, deletion or substitution away.

        The automaton of ``word`` is run over the trie: its state is, for 0 and for 1 errors, the set
        of positions of the word that may have been reached, as bits.  One error leaves the first or
        the last two letters of a term in place, which rules most words out beforehand.
        """
        n = len(word)
        if n < FUZZY_FROM - 1 or n > self.longest + 1:
            return []
        if word[:2] not in self.heads and word[-2:] not in self.tails:
            return []
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        end, found = 1 << n, []
        stack = [(self.root, 1, 2)]
        while stack:
            node, none, one = stack.pop()
            if "fuzzy" in node and (none | one) & end:
                found.append(node["fuzzy"])
            for c, child in node.items():
                if len(c) > 1:
                    continue
                fits = at.get(c, 0)
                clean = (none & fits) << 1
                # a right letter, a superfluous term letter, a substituted one, a superfluous word letter
                erred = (one & fits) << 1 | none | none << 1 | clean << 1
                erred &= (end << 1) - 1
                if clean or erred:
                    stack.append((child, clean, erred))
        return found


class _Weights(dict):
    """Weight of each distinct word, signed: negative for a misspelled term; forgets when full."""

    def __init__(self, trie: Trie) -> None:
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        weight = self.trie.exact(word) or -self.trie.fuzzy(word)[0]
        self[word] = weight
        return weight


def _quoted(text: str, at: int) -> bool:
    """Whether a quotation opened in this line is closed after ``at``."""
    start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
    before, after = text[start:at], text[at : end if end >= 0 else None]
    if before.count('"') % 2 and '"' in after:
        return True
    for a, b in zip(_OPEN, _CLOSE):
        if a in before and before.rfind(a) > before.rfind(b) and b in after:
            return True
    return False


def features(text: str, weights: _Weights) -> list[float]:
    """What the classifier sees of a whole text."""
    lower = text.lower()
    found = _WORD.findall(lower)
    hits = [i for i, w in enumerate(map(weights.__getitem__, found)) if w] if found else []
    if not hits:
        return [0.0] * N_FEATURES
    spans = _WORD.finditer(lower)
    count = 0.0
    scored: list[tuple[int, float]] = []
    wanted = set(hits)
    for i, span in enumerate(spans):
        if i not in wanted:
            continue
        weight = weights[found[i]]
        share = (QUOTED if _quoted(lower, span.start()) else 1.0) * (1.0 if weight > 0 else MISSPELLED)
        count += share
        scored.append((i, abs(weight) * share))
    densest = run = 0.0
    first = 0
    for i, weight in scored:
        run += weight
        while i - scored[first][0] >= WINDOW:
            run -= scored[first][1]
            first += 1
        densest = max(densest, run)
    total = sum(w for _, w in scored)
    return [
        math.log1p(count), densest / 4, math.log1p(total),
        math.log1p(100 * total / len(found)), max(w for _, w in scored) / 4,
    ]


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of words and stems, by class, summed within each slice."""
    for batch in slices(batches):
        counts: Counter = Counter()
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            words = {w for w in _WORD.findall((text.as_py() or "").lower()) if w.isalpha() and len(w) >= STEM[0]}
            stems = {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}
            counts.update((w, False, toxic) for w in words)
            counts.update((s, True, toxic) for s in stems)
        rows = list(zip(*((*k, n) for k, n in counts.items()))) or [[]] * 4
        types = (pa.string(), pa.bool_(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(rows, types)], names=["term", "stem", "toxic", "n"]
        )


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Text and label of at most ``rows`` labelled documents outside the held-out fold, by id hash."""
    ids = labels.where(F.col("toxic").isin(0, 1) & ~learn_fold("doc_id", 5, 0) & F.col("doc_id").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    present = docs.select("doc_id").distinct().join(ids, "doc_id")
    chosen = cut(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def passing_terms(sample: DataFrame) -> DataFrame:
    """(term, stem, bad, weight) of the words and stems that pass the thresholds, stems that cover them or not.

    The weight is the log odds of the shares of toxic and clean documents.
    """
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    passing = (
        sample.mapInArrow(_terms, "term string, stem boolean, toxic int, n long")
        .groupBy("term", "stem")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("all"))
        .where(F.col("bad") >= LEAST_DOCS)
        .withColumn("p", (F.col("bad") + 0.0) / (toxic + 1))
        .withColumn("q", (F.col("all") - F.col("bad") + 0.5) / (clean + 1))
        .where(F.col("p") >= F.lit(LEAST_SHARE / (1 - LEAST_SHARE)) * F.col("q"))
        .select("term", "stem", "bad", F.log(F.col("p") / F.col("q")).alias("weight"))
    )
    return cut(passing)


def learn_lexicon(passing: DataFrame) -> list[tuple[str, bool, float]]:
    """At most ``LEXICON`` (term, is stem, weight) of the terms that pass."""
    best = passing.orderBy(F.desc(F.col("weight") * F.col("bad")), "stem", F.length("term"), "term")
    counts = best.limit(LEXICON).collect()
    chosen: list[tuple[str, bool, float]] = []
    stems: dict[str, float] = {}
    for r in counts:  # best first; what a chosen stem already covers adds nothing
        covering = max((stems.get(r["term"][:n], 0.0) for n in range(STEM[0], len(r["term"]) + 1)), default=0.0)
        if covering >= r["weight"] - 0.5:
            continue
        chosen.append((r["term"], r["stem"], r["weight"]))
        if r["stem"]:
            stems[r["term"]] = r["weight"]
    return chosen


def _near_misses(lexicon: list[tuple[str, bool, float]], terms: list[str]):
    """Of how many clean documents does each term have a near miss that is no hit itself?"""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(lexicon, terms)
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text"):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                counts.update({term for w in words if not trie.exact(w) for _, term in trie.near(w)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"]
            )

    return run


def learn_fuzzy(sample: DataFrame, lexicon: list[tuple[str, bool, float]], passing: DataFrame) -> list[str]:
    """The words whose near misses are not ordinary words of clean documents.

    All words that pass and are hits take part, those too that only a stem of the lexicon covers: the
    stem finds no misspelling in its own letters.
    """
    words = passing.where(~F.col("stem") & (F.length("term") >= FUZZY_FROM)).select("term").orderBy("term").collect()
    known = Trie(lexicon, [])
    terms = [r["term"] for r in words if known.exact(r["term"])]
    clean = sample.where("toxic = 0")
    counts = clean.mapInArrow(_near_misses(lexicon, terms), "term string, n long").groupBy("term").sum("n").collect()
    most = FUZZY_CLEAN * clean.count()
    common = {r["term"] for r in counts if r["sum(n)"] > most}
    return [t for t in terms if t not in common]


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = -2.0
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(hessian, gradient)
    return w


class Model:
    """Lexicon and weights; a few hundred terms, sent to every task."""

    def __init__(self, lexicon: list[tuple[str, bool, float]], fuzzy: list[str], weights: np.ndarray) -> None:
        self.lexicon, self.fuzzy, self.weights = lexicon, fuzzy, weights


def _featured(lexicon: list[tuple[str, bool, float]], fuzzy: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(Trie(lexicon, fuzzy))
        for batch in batches:
            x = [features(t.as_py() or "", weights) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"]
            )

    return run


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fit on at most ``rows`` labelled documents; the driver gets terms and a few numbers of each."""
    sample = written(labelled_sample(docs, labels, rows), "labelled")
    passing = passing_terms(sample)
    lexicon = learn_lexicon(passing)
    if not lexicon:
        return Model([], [], np.zeros(N_FEATURES + 1))
    fuzzy = learn_fuzzy(sample, lexicon, passing)
    fitted = sample.mapInArrow(_featured(lexicon, fuzzy), "x array<double>, toxic int").collect()
    x, y = np.array([r["x"] for r in fitted]), np.array([r["toxic"] for r in fitted], dtype=float)
    return Model(lexicon, fuzzy, fit_weights(x, y))


def _scorer(model: Model):
    lexicon, fuzzy, w = model.lexicon, model.fuzzy, model.weights

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = _Weights(Trie(lexicon, fuzzy))
        for batch in texts:
            x = np.array([features(t.as_py() or "", weights) for t in batch]).reshape(len(batch), N_FEATURES)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) if lexicon else np.zeros(len(batch)))

    score.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double").asNondeterministic()


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1; only the text is read for it, and read whole.

    Null and empty texts get the score of a text without hits; rows are scored one by one, so repeated
    rows score alike; without labelled toxic documents every score is 0; an empty table stays empty;
    all columns stay.
    """
    return docs.withColumn(name, _scorer(model)("text"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5) of every document."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels), "score")
    return scored.select(
        "doc_id", learn_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns stay."""
    name = "__toxicity"
    return score(docs, learn(docs, labels), name).where(F.col(name) < 0.5).drop(name)
