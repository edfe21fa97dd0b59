import hashlib

import duckdb
import numpy as np
import pytest

from gristmill.llm.centroids import assign_clusters, bisectors, clusters_sql, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, key string, x string, d string"
NAN, INF = float("nan"), float("inf")


def brute(vectors, k, rounds, width):
    """All distances, in Python's numbers."""
    kept = []
    for i, v in vectors:
        if v is None or len(v) != width or any(c is None or not np.isfinite(c) or abs(c) >= 2**53 for c in v):
            continue
        kept.append((i, [int(np.floor(256 * float(np.float32(c)))) for c in v]))
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(((name(i), x) for i, x in kept))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    give = lambda: [min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j)) for _, x in kept]
    for _ in range(rounds):
        found = give()
        for j in range(len(centroids)):
            mine = [x for (_, x), c in zip(kept, found) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = give()
    distance = [far(x, centroids[c]) for (_, x), c in zip(kept, found)]
    fits = lambda v: v if v < 1 << 63 else None
    out = []
    for (i, _), c, d in zip(kept, found, distance):
        mine = [e for e, o in zip(distance, found) if o == c]
        inertia = fits(sum(mine)) if all(fits(e) is not None for e in mine) else None
        total = fits(sum(distance)) if all(fits(e) is not None for e in distance) else None
        out.append((i, c, fits(d), inertia, total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, vectors, **options):
    frame = spark.createDataFrame([(i, v, None, "a", "b", "c", "d", "e") for i, v in vectors], SCHEMA).repartition(3)
    done = assign_clusters(frame, **options)
    assert done.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in done.collect()), key=repr)


def some(rng, n, width):
    return [[float(np.float32(c)) for c in row] for row in rng.normal(size=(n, width))]


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = list(enumerate(some(rng, 400, 5)))
    vectors += [(1000 + i, vectors[7][1]) for i in range(200)]  # one vector for a third of all rows
    assert run(spark, vectors, clusters=9, width=5) == brute(vectors, 9, 5, 5)


def test_ties_go_to_the_smaller_number(spark):
    # few values, so that many vectors lie on a bisector, and equal centroids
    rng = np.random.default_rng(4)
    vectors = [(i, [float(c) / 256 for c in row]) for i, row in enumerate(rng.integers(-2, 3, size=(300, 2)))]
    assert run(spark, vectors, clusters=12, width=2) == brute(vectors, 12, 5, 2)


def test_odd_rows(spark):
    vectors = [
        (0, [1.0, 2.0]), (1, None), (2, [NAN, 1.0]), (3, [INF, 1.0]), (4, [1.0, None]), (None, [1.0, 1.0]), (5, [3.0]), (6, []),
        (0, [1.0, 2.0]), (0, [-1.0, 2.0]), (7, [1e16, 0.0]), (8, [-0.0, 0.0]), (9, [-0.001, 0.001]),
    ]
    assert run(spark, vectors, clusters=4, width=2) == brute(vectors, 4, 5, 2)
    assert run(spark, vectors, clusters=40, width=2) == brute(vectors, 40, 5, 2)
    assert run(spark, [], width=2) == []
    assert run(spark, [(1, None), (2, [1.0])], width=2) == []


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(5)
    for size in (2.0**17, 2.0**22, 2.0**40):
        vectors = [(i, [float(np.float32(c)) for c in row * size]) for i, row in enumerate(rng.normal(size=(60, 3)))]
        assert run(spark, vectors, clusters=5, width=3, rounds=2) == brute(vectors, 5, 2, 3)


@pytest.mark.parametrize("size", [3, 1 << 27])
def test_tournament_leaves_the_nearest(size):
    rng = np.random.default_rng(6)
    c = rng.integers(-size, size + 1, size=(15, 2)).tolist()
    x = rng.integers(-size, size + 1, size=(500, 2))
    wide = x.astype(object)
    far = np.array([((wide - np.array(m, dtype=object)) ** 2).sum(axis=1) for m in c])
    assert nearest(x, *bisectors(c)).tolist() == [min(range(15), key=lambda j: (col[j], j)) for col in far.T]


def test_sql_twin(spark):
    rng = np.random.default_rng(8)
    vectors = list(enumerate(some(rng, 200, 6))) + [(None, None), (500, [1.0]), (3, some(rng, 1, 6)[0])]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", vectors)
    want = con.execute(clusters_sql(clusters=7, width=6)).fetchall()
    assert run(spark, vectors, clusters=7, width=6) == sorted(want, key=repr)
