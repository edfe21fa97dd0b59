"""Whitening of embeddings along the leading components of their covariance, found by spectrum slicing.

Tasks sum the outer products of whole-number vectors, so the covariance is exact before it is rounded
once.  The factorization ``V - s I = L D L^T`` counts the eigenvalues above a shift ``s`` by the signs
of D (Sylvester's law); halving an interval by such counts isolates one leading eigenvalue after the
other, Rayleigh quotient iteration sharpens it, and counts just beside the result certify its number.
Only matrices of the vectors' width reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import new_path, removed, stored
from gristmill.llm.vectors import matrix, whole

COMPONENTS = 4
_ROWS = 4096
_MERGED = 32  # rows of sums that reach the driver
_EPS = float(np.finfo(float).eps)


def pivots(a: np.ndarray) -> tuple[int, int, int]:
    """Numbers of positive, negative and zero eigenvalues of symmetric ``a``, by the signs of D in LDL^T.

    The largest entry left is made the pivot: one diagonal entry, or two rows where an entry off the
    diagonal is much larger; such a block of two has one eigenvalue of either sign.
    """
    a = a.copy()
    positive = negative = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = divmod(int(off.argmax()), len(a))
        if max(diagonal[p], off[i, j]) == 0.0:
            break
        if diagonal[p] >= 0.6403882 * off[i, j]:  # (1 + sqrt 17) / 8 bounds the growth of entries
            d = a[p, p]
            positive, negative = positive + (d > 0), negative + (d < 0)
            rest = np.delete(np.arange(len(a)), p)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, p], a[rest, p]) / d
        else:
            positive, negative = positive + 1, negative + 1
            rest = np.delete(np.arange(len(a)), [i, j])
            side = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_([i, j], [i, j])], side.T)
            a = (a + a.T) / 2
    return int(positive), int(negative), len(a)


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` exceed ``shift``."""
    return pivots(v - shift * np.eye(len(v)))[0]


def _solved(v: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(v - shift I)^-1 right, with the shift moved by ``tiny`` where it hits an eigenvalue."""
    while True:
        try:
            found = np.linalg.solve(v - shift * np.eye(len(v)), right)
            if np.isfinite(found).all():
                return found
        except np.linalg.LinAlgError:
            pass
        shift, tiny = shift + tiny, 2 * tiny


def leading(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of positive semidefinite ``v``, falling, and their unit vectors as columns.

    Eigenvalues closer than rounding allows to tell are taken together: any basis of their space is theirs.
    """
    width = len(v)
    count = min(count, width)
    size = float(np.abs(v).sum(axis=1).max()) if width else 0.0  # no eigenvalue is larger
    if size == 0.0:
        return np.zeros(count), np.eye(width)[:, :count]
    least = 8 * width * _EPS * size  # counts closer than this to an eigenvalue are rounding
    rng = np.random.default_rng(0)
    values: list[float] = []
    basis = np.zeros((width, 0))
    while len(values) < count:
        # found eigenvalues are moved to -size, so that counts and solutions see only the others
        rest = v - (basis * (np.array(values) + size)) @ basis.T
        low, high, inside = -size / 2, (values[-1] if values else size) + least, width - len(values)
        while inside > 1 and high - low > least:
            middle = (low + high) / 2
            n = above(rest, middle)
            if n >= 1:
                low, inside = middle, n
            else:
                high = middle
        found = _isolated(rest, low, high, basis, least, rng) if inside == 1 else None
        if found is None:
            found = _together(rest, (low + high) / 2, max(inside, 1), basis, least, rng)
        for value, vector in zip(*found):
            values.append(float(value))
            basis = np.column_stack([basis, vector])
    order = sorted(range(len(values)), key=lambda i: -values[i])
    values, basis = [values[i] for i in order], basis[:, order]
    for k, value in enumerate(values):  # its number, by counts of the matrix as it was given
        if above(v, value + 2 * least) > k or above(v, value - 2 * least) <= k:
            raise ArithmeticError(f"eigenvalue {k + 1} is not where it was found: {value}")
    return np.array(values[:count]), basis[:, :count]


def _apart(y: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``y`` without its part in ``basis``, of length one."""
    for _ in range(2):
        y = y - basis @ (basis.T @ y)
    return y / np.linalg.norm(y)


def _isolated(v, low, high, basis, least, rng):
    """The one eigenvalue in (low, high) and its vector, or None if it lies too near to another for counts to part."""
    while True:
        y = _apart(rng.normal(size=len(v)), basis)
        for _ in range(2):
            y = _apart(_solved(v, (low + high) / 2, y, least), basis)
        value = y @ v @ y
        for _ in range(30):  # cubic; a handful is enough
            if np.linalg.norm(v @ y - value * y) <= least / 8:
                break
            y = _apart(_solved(v, value, y, least / 8), basis)
            value = y @ v @ y
        if low - least <= value <= high + least and above(v, value - least) == 1 and above(v, value + least) == 0:
            y = _apart(_solved(v, value, y, least / 8), basis)
            return [y @ v @ y], [y]
        if high - low <= least:
            return None
        middle = (low + high) / 2
        low, high = (middle, high) if above(v, middle) else (low, middle)


def _together(v, shift, m, basis, least, rng):
    """``m`` eigenvalues around ``shift`` that rounding cannot part, by inverse iteration with a block."""
    block = rng.normal(size=(len(v), m))
    for _ in range(6):
        block = _solved(v, shift, block, least / 8)
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        block = np.linalg.qr(block)[0]
    values, turn = np.linalg.eigh(block.T @ v @ block)
    return values[::-1], (block @ turn)[:, ::-1].T


def _text(numbers: np.ndarray) -> str:
    return json.dumps([int(x) for x in numbers.ravel()])


def _moments(width: int):
    """Per task the sum of vectors and of outer products, exact, as decimal numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        products = np.zeros((width, width), dtype=object)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                x = matrix(batch.column("x").slice(start, _ROWS), width)
                most = max(-int(x.min()), int(x.max())) if x.size else 0
                if most * most * len(x) < 1 << 53:  # exact in floating point
                    outer = (x.T.astype(float) @ x.astype(float)).astype(np.int64).astype(object)
                else:
                    outer = x.T.astype(object) @ x.astype(object)
                products += outer
                total += x.sum(axis=0, dtype=object) if most >= 1 << 50 else x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([_text(total)]), pa.array([_text(products)])], names=["s", "m"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """Many rows of sums as one."""
    add = lambda texts: _text(sum(np.array(json.loads(t), dtype=object) for t in texts))
    return pd.DataFrame({"s": [add(rows["s"])], "m": [add(rows["m"])]})


def covariance(fit: DataFrame, n: int, width: int) -> tuple[list[int], np.ndarray]:
    """Sums per dimension and the covariance (divisor ``n``) of ``x``, each entry rounded once."""
    sums = fit.select("x").mapInArrow(_moments(width), "s string, m string")
    merged = sums.withColumn("g", F.spark_partition_id() % _MERGED).groupBy("g")
    s, m = np.zeros(width, dtype=object), np.zeros(width * width, dtype=object)
    for r in merged.applyInPandas(_added, "s string, m string").collect():  # _MERGED matrices at most
        s = s + np.array(json.loads(r["s"]), dtype=object)
        m = m + np.array(json.loads(r["m"]), dtype=object)
    centred = n * m.reshape(width, width) - np.outer(s, s)
    return [int(x) for x in s], np.array([[int(c) / (n * n) for c in row] for row in centred], dtype=float).reshape(width, width)


def _projected(x: np.ndarray, n: int, sums: list[int], axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deviations n x - S (exact modulo 2^64, and rounded) and the vectors along ``axes``."""
    s = np.array([v % (1 << 64) for v in sums], dtype=np.uint64)
    wrapped = x.astype(np.uint64) * np.uint64(n) - s
    most = max(-int(x.min()), int(x.max())) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        centred = wrapped.view(np.int64) / n
    else:
        centred = x.astype(float) - np.array([v / n for v in sums])
    # summed row by row, so that equal vectors get equal results wherever they stand
    return wrapped, centred, np.column_stack([(centred * a).sum(axis=1) for a in axes.T])


def _spread(n: int, width: int, sums: list[int], axes: np.ndarray):
    """Per task the sums and products of whitened components, for their covariance."""
    k = axes.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                z = _projected(matrix(batch.column("x").slice(start, _ROWS), width), n, sums, axes)[2]
                total += np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    return run


def _deviations(wrapped: np.ndarray, x: np.ndarray, n: int, sums: list[int], centred: np.ndarray) -> list[int | None]:
    """Sums of squares of n x - S; null beyond 64 bits."""
    about = ((centred * n) ** 2).sum(axis=1)
    exact = (wrapped * wrapped).sum(axis=1).view(np.int64)  # right where the true sum fits
    out: list[int | None] = []
    for i, (rough, value) in enumerate(zip(about.tolist(), exact.tolist())):
        if abs(rough - 2.0**63) < 2.0**43:  # too near the edge for the estimate
            true = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums))
            out.append(true if true < 1 << 63 else None)
        else:
            out.append(value if rough < 2.0**63 else None)
    return out


def _whitened(n: int, width: int, sums: list[int], axes: np.ndarray, usable: list[bool], explained: list[float | None], error: float | None):
    k = axes.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(start, _ROWS)
                x = matrix(piece.column("x"), width)
                wrapped, centred, z = _projected(x, n, sums, axes)
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("key").take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        pa.array([n] * len(rows), pa.int64()),
                        pa.array(_deviations(wrapped, x, n, sums, centred), pa.int64()).take(pa.array(rows)),
                        pa.array(z.ravel(), pa.float64(), mask=np.tile(~np.array(usable), len(x))),
                        pa.array(explained * len(x), pa.float64()),
                        pa.array([error] * len(rows), pa.float64()),
                    ],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each usable vector along the ``components`` leading axes of the covariance, scaled to unit variance.

    Entries become x = floor(256 * entry).  Mean and covariance are those of the distinct vectors x.

    Returns per row and component: ``key``, component int (from 1, by falling variance), n long (distinct
    vectors), deviation long (sum of (n x - S)^2, S the sums per dimension), whitened double, explained
    double (share of the whole variance), identity_error double (largest entry of the covariance of
    ``whitened`` over the distinct vectors minus the identity).

    Left out: null vectors, vectors with null entries, entries that are not finite or reach 2^53.  Shorter
    vectors count as filled with zeros.  Repeated rows and rows without a key are all returned, and count
    once in the fit if their vectors are equal.  Vectors of fewer dimensions have fewer components.  Where
    no variance is left (fewer distinct vectors than components, or constant ones) whitened is null, and
    that component is left out of identity_error; without any variance explained and identity_error are
    null.  A deviation beyond 64 bits is null.  An empty table gives an empty result.  Variances that are
    equal up to rounding have any basis of their space as axes.  Other columns are not looked at.
    The driver holds width x width numbers.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    names = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows_at, fit_at = new_path(spark, "whole-vectors"), new_path(spark, "fit-vectors")
    rows = stored(whole(vectors, key, vector).select(F.col(key).alias("key"), "x"), rows_at)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return spark.createDataFrame([], f"`{key}` {kind}, {names}")
    missing = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
    fit = stored(rows.select(F.concat("x", missing).alias("x")).distinct(), fit_at)
    n = fit.count()
    sums, v = covariance(fit, n, width)
    values, axes = leading(v, components)
    trace = float(np.trace(v))
    floor = 8 * width * _EPS * float(np.abs(v).sum(axis=1).max())
    usable = [bool(e > floor) for e in values]
    scaled = axes / np.sqrt(np.where(usable, values, 1.0))
    k = len(values)
    found = fit.select("x").mapInArrow(_spread(n, width, sums, scaled), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(k + k * k)
    for r in found:
        total[r["i"]] = r["v"]
    mean = total[:k] / n
    off = np.abs(total[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k))[np.ix_(usable, usable)]
    error = float(off.max()) if off.size else None
    explained = [max(float(e), 0.0) / trace if trace > 0 else None for e in values]
    removed(spark, fit_at)
    done = rows.mapInArrow(_whitened(n, width, sums, scaled, usable, explained, error), f"key {kind}, {names}")
    return done.withColumnRenamed("key", key)
