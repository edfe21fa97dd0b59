import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm.whitening import above, leading, pivots, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, component string, n string, x string, key string, s string"
NAN, INF = float("nan"), float("inf")


def kept(vectors):
    good = [(i, v) for i, v in vectors if v is not None and not any(c is None or not np.isfinite(c) or abs(c) >= 2**53 for c in v)]
    width = max((len(v) for _, v in good), default=0)
    return [(i, tuple([int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)))) for i, v in good]


def check(spark, vectors, components=4):
    frame = spark.createDataFrame([(i, v, None, "a", "b", "c", "d", "e") for i, v in vectors], SCHEMA).repartition(3)
    rows = whiten(frame, components=components).collect()
    want = kept(vectors)
    if not want or not len(want[0][1]):
        assert rows == []
        return
    fit = sorted(set(x for _, x in want))
    n, width = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    k = min(components, width)
    assert len(rows) == k * len(want)
    deviation = lambda x: sum((n * a - s) ** 2 for a, s in zip(x, sums))
    fits = lambda v: v if v < 1 << 63 else None
    expected = sorted(((i, c, n, fits(deviation(x))) for i, x in want for c in range(1, k + 1)), key=repr)
    assert sorted(((r.vec_id, r.component, r.n, r.deviation) for r in rows), key=repr) == expected
    centred = np.array([[a - s / n for a, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    return rows, {i: x for i, x in want}, sums, n, values, axes, np.trace(v)


def test_against_a_dense_solver(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 9)) * np.array([5, 3, 2, 1.5, 1, 1, 0.5, 0.2, 0.1]) + 2
    vectors = [(i, row.tolist()) for i, row in enumerate(data)] + [(1000 + i, data[3].tolist()) for i in range(150)]
    rows, whole, sums, n, values, axes, trace = check(spark, vectors)
    for c in range(1, 5):
        mine = {r.vec_id: r for r in rows if r.component == c}
        got = np.array([mine[i].whitened for i in whole])
        want = np.array([[a - s / n for a, s in zip(x, sums)] for x in whole.values()]) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert abs(mine[0].explained - values[c - 1] / trace) < 1e-12 and mine[0].identity_error < 1e-9
        assert len({r.whitened for r in mine.values() if r.vec_id >= 1000}) == 1  # repeated vectors count once


def test_odd_rows(spark):
    vectors = [
        (0, [1.0, 2.0, 0.5]), (1, None), (2, [NAN, 1.0]), (3, [INF]), (4, [1.0, None]), (None, [1.0, 1.0, -3.0]), (5, [3.0]), (6, []),
        (0, [1.0, 2.0, 0.5]), (7, [1e16]), (8, [-0.0, 0.0, 0.1]), (9, [0.7, -5.0, 1.0]), (10, [4.0, 4.0, 4.0]),
    ]
    check(spark, vectors)
    check(spark, [])
    check(spark, [(1, None), (2, [])])


def test_without_variance(spark):
    for vectors in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        rows = check(spark, vectors)[0]
        assert all((r.whitened, r.explained, r.identity_error) == (None, None, None) for r in rows)
    rows = check(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)])[0]  # all on one line
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in rows)


def test_large_entries(spark):
    rng = np.random.default_rng(2)
    for size in (2.0**12, 2.0**24, 2.0**40):  # the middle one has deviations on both sides of 64 bits
        data = rng.normal(size=(40, 4)) * size * np.linspace(0.1, 2, 40)[:, None]
        rows = check(spark, [(i, row.tolist()) for i, row in enumerate(data)])[0]
        assert rows[0].identity_error < 1e-6


@pytest.mark.parametrize("spectrum", [[5, 3, 2, 1, 0.5], [3, 3, 3, 1, 1, 0], [1] * 6, [2, 2 - 1e-14, 1, 0, 0], [1, 1e-9, 1e-12, 0], [0, 0]])
def test_slicing(spectrum):
    rng = np.random.default_rng(len(spectrum))
    turn = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))[0]
    v = turn @ np.diag(np.array(spectrum, dtype=float)) @ turn.T
    v = (v + v.T) / 2
    values, axes = leading(v, 4)
    assert np.abs(values - sorted(spectrum, reverse=True)[:4]).max() < 1e-13
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-13 and np.abs(v @ axes - axes * values).max() < 1e-13


def test_inertia_counts():
    rng = np.random.default_rng(9)
    for _ in range(300):
        w = rng.integers(1, 9)
        a = rng.integers(-2, 3, size=(w, w)).astype(float)
        a = a + a.T
        t = np.linalg.eigvalsh(a)
        if np.abs(t[np.abs(t) < 1e-6]).size == 0:
            assert pivots(a) == ((t > 0).sum(), (t < 0).sum(), 0)
            assert above(a, 0.37) == (t > 0.37).sum()


def test_only_small_results_reach_the_driver(spark):
    frame = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i) for i in range(8)]).alias("embedding")).repartition(200)
    assert whiten(frame).count() == 8000
