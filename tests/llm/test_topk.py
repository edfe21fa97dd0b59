import duckdb
import numpy as np
from pyspark.sql import functions as F

from gristmill.llm.topk import top_k, top_k_sql

SCHEMA = "vec_id long, embedding array<float>, label int, score string, length string"
NAN, INF = float("nan"), float("inf")


def brute(vectors, is_query, k):
    whole = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole[i] = np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)
    out = []
    for q in whole:
        if is_query(q):
            n = max(len(x) for x in whole.values())
            pad = lambda x: np.pad(x, (0, n - len(x)))
            scored = sorted((-int(pad(whole[q]) @ pad(v)), i) for i, v in whole.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, vectors, every, k=5, **sizes):
    frame = spark.createDataFrame([(i, v, None, "x", "y") for i, v in vectors], SCHEMA).repartition(3)
    rows = top_k(frame, F.col("vec_id") % every == 0, k, **sizes).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows)


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    scale = rng.lognormal(0, 1, 700)
    data = rng.normal(size=(700, 12)) * scale[:, None] + rng.normal(size=12)
    vectors = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(data)]
    vectors += [(700 + i, vectors[10][1]) for i in range(40)]  # ties
    assert run(spark, vectors, 10, block=64, query_block=8) == brute(vectors, lambda i: i % 10 == 0, 5)


def test_one_vector_for_most_rows(spark):
    vectors = [(i, [0.5, -0.25, 0.125]) for i in range(300)] + [(300 + i, [0.1 * i, 0.2, -0.3]) for i in range(30)]
    assert run(spark, vectors, 30, block=32, query_block=4) == brute(vectors, lambda i: i % 30 == 0, 5)


def test_odd_rows(spark):
    vectors = [
        (0, [1.0, 2.0]), (10, None), (20, [NAN, 1.0]), (30, [INF, 1.0]), (40, [1.0, None]), (None, [1.0, 1.0]),
        (1, [3.0]), (2, []), (50, [1.0, 2.0]), (0, [1.0, 2.0]),
    ]
    assert run(spark, vectors, 10) == brute(vectors, lambda i: i % 10 == 0, 5)
    assert run(spark, [], 10) == []
    assert run(spark, [(10, [1.0])], 10) == []
    assert run(spark, [(11, [1.0]), (12, [2.0])], 10) == []


def test_other_vectors_under_one_id(spark):
    rng = np.random.default_rng(9)
    data = [[float(np.float32(x)) for x in row] for row in rng.normal(size=(200, 6))]
    vectors = [(i % 80, v) for i, v in enumerate(data)]  # queries and candidates, two or three times each
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", vectors)
    want = sorted((q, r, v, s) for q, r, v, s in con.execute(top_k_sql(every=10)).fetchall())
    got = run(spark, vectors, 10, block=32, query_block=4)
    assert got == want and any((q, r + 1, v) in {w[:3] for w in want} for q, r, v, _ in want)
