"""Clusters around centroids by a tournament of bisectors, in whole numbers.

Two centroids i < j are parted by the hyperplane of all points equally far from both.  Its normal
``2 (c_j - c_i)`` and threshold ``|c_j|^2 - |c_i|^2`` are whole numbers, so the sign of one inner
product says exactly which of the two is nearer.  Each vector meets the centroids in ascending
order: the winner so far is tested against the next, so k - 1 tests leave one, and a zero leaves
the smaller number.  Only the distance to the winner is worked out.

Spark holds the vectors; a task returns a sum and a count per cluster, and the driver sees nothing
but k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import new_path, removed, stored, written
from gristmill.llm.vectors import LIMIT, SCALE, exact, matrix, whole

WIDTH = 64
CLUSTERS = 40
ROUNDS = 5
_SAFE = 1 << 26  # below this, 64 products of a normal and a vector stay within 64 bits
_ROWS = 4096  # vectors that meet the centroids at once


def bisectors(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Normals and thresholds of all pairs; ``x @ normals[i, j] > thresholds[i, j]`` where j is nearer than i."""
    c = exact(np.array(centroids, dtype=np.int64), _SAFE)
    square = (c * c).sum(axis=1)
    return 2 * (c[None, :, :] - c[:, None, :]), square[None, :] - square[:, None]


def nearest(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, the smaller one of equally near ones."""
    x = exact(x, _SAFE)
    if normals.dtype == object or x.dtype == object:
        x, normals, thresholds = x.astype(object), normals.astype(object), thresholds.astype(object)
    winner = np.zeros(len(x), dtype=np.int64)
    for j in range(1, len(thresholds)):
        side = (x * normals[winner, j]).sum(axis=1) - thresholds[winner, j]
        winner[side > 0] = j
    return winner


def _pieces(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(start, _ROWS)
            yield piece, matrix(piece.column("x"), width)


def _sums(centroids: list[list[int]]):
    """Per task and cluster: count and componentwise sum of the vectors nearest to it."""
    width = len(centroids[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, thresholds = bisectors(centroids)
        counts = [0] * len(centroids)
        sums = np.zeros((len(centroids), width), dtype=object)
        for _, x in _pieces(batches, width):
            winner = nearest(x, normals, thresholds)
            x = exact(x, 1 << 50)
            for c in np.unique(winner):
                mine = x[winner == c]
                counts[c] += len(mine)
                sums[c] += mine.sum(axis=0).astype(object)
        found = [c for c, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found, pa.int32()),
                pa.array([counts[c] for c in found], pa.int64()),
                pa.array([[Decimal(int(v)) for v in sums[c]] for c in found], pa.list_(pa.decimal128(38, 0))),
            ],
            names=["cluster", "n", "sums"],
        )

    return run


def _assigned(centroids: list[list[int]]):
    """Key, nearest centroid and the squared distance to it; null if that takes more than 64 bits."""
    width = len(centroids[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, thresholds = bisectors(centroids)
        c = np.array(centroids, dtype=np.int64)
        for piece, x in _pieces(batches, width):
            winner = nearest(x, normals, thresholds)
            if max(abs(int(m)) for m in (x.min(), x.max(), c.min(), c.max())) < _SAFE:
                distance = ((x - c[winner]) ** 2).sum(axis=1).tolist()
            else:
                wide = x.astype(object) - c[winner].astype(object)
                distance = [d if d < 1 << 63 else None for d in (wide * wide).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(winner, pa.int32()), pa.array(distance, pa.int64())], names=["key", "cluster", "distance"])

    return run


def assign_clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, salt: str = "2:") -> DataFrame:
    """Each usable vector with its cluster after ``rounds`` rounds of moving the centroids.

    The first centroids are the vectors with the smallest SHA-256 of ``salt`` and key.  A round gives each
    vector to its nearest centroid and moves every centroid that has vectors to the floor of their mean.

    Returns ``key``, cluster int, distance long (squared), cluster_inertia and inertia long (sums of
    distance), centroid_sha256 string (components as decimal numbers joined by commas).

    Left out: null vectors, vectors of another length than ``width``, with null entries, entries that
    are not finite or reach 2^53.  Rows without a key take part; their digest is that of the salt alone.
    Repeated rows each count.  Equal digests (a repeated key) are ordered by the vector.  With fewer
    usable rows than ``clusters``, each is a first centroid; centroids may be equal, then the smaller number
    gets the vectors.  An empty table gives an empty result.  Distances and sums beyond 64 bits are null.
    Other columns are not looked at.  A task holds clusters^2 x ``width`` numbers (0.8 MB at the defaults), so
    this is meant for hundreds of centroids, not for many thousands.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    path = new_path(spark, "vectors")
    rows = stored(whole(vectors, key, vector).where(F.size("x") == width).select(F.col(key).alias("key"), "x"), path)
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = rows.select("x", digest.alias("digest")).orderBy("digest", "x").limit(clusters).collect()
    centroids = [list(r["x"]) for r in sorted(first, key=lambda r: (r["digest"], r["x"]))]
    out = f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], out)
    for _ in range(rounds):
        parts = rows.select("x").mapInArrow(_sums(centroids), "cluster int, n long, sums array<decimal(38,0)>")
        # clusters x width sums, whatever the table
        spread = parts.select("cluster", "n", F.posexplode("sums").alias("d", "v"))
        found = spread.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
        for r in found:
            centroids[r["cluster"]][r["d"]] = int(r["v"]) // r["n"]
    schema = f"key {kind}, cluster int, distance long"
    done = written(rows.mapInArrow(_assigned(centroids), schema), "clusters")
    removed(spark, path)
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("n"), F.count(F.lit(1)).alias("all")).collect()
    fits = lambda ok, v: int(v) if ok and v is not None and v < 1 << 63 else None
    total = fits(all(r["n"] == r["all"] for r in sums), sum(r["s"] or 0 for r in sums))
    names = [
        (r["cluster"], fits(r["n"] == r["all"], r["s"]), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest())
        for r in sums
    ]
    # one row per centroid
    about = F.broadcast(spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return done.join(about, "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> str:
    """The same in SQL, by distances to all centroids."""
    steps = [
        f"""kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda c: cast(floor(cast(c as double) * {SCALE}) as bigint)) as x
  from embeddings
  where embedding is not null and len(embedding) = {width}
    and len(list_filter(embedding, lambda c: c is null or isnan(c) or abs(c) >= {LIMIT:.0f})) = 0)""",
        "cells as materialized (select r, unnest(x) as v, generate_subscripts(x, 1) as d from kept)",
        f"""c0 as materialized (
  select row_number() over (order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), x) - 1 as k, x
  from kept qualify k < {clusters})""",
        "m0 as materialized (select k, unnest(x) as c, generate_subscripts(x, 1) as d from c0)",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (
  select r, arg_min(k, (s, k)) as k, min(s) as s from (
    select r, k, sum((v - c) * (v - c)) as s from cells join m{i} using (d) group by r, k) group by r)""")
        if i < rounds:
            steps.append(f"""m{i + 1} as materialized (
  select o.k, o.d, coalesce(cast((n.s - ((n.s % n.n) + n.n) % n.n) // n.n as bigint), o.c) as c
  from m{i} o left join (
    select k, d, cast(sum(v) as bigint) as s, count(*) as n from cells join a{i} using (r) group by k, d) n on n.k = o.k and n.d = o.d)""")
    steps.append(f"names as (select k, sha256(string_agg(cast(c as varchar), ',' order by d)) as h from m{rounds} group by k)")
    return "with " + ",\n".join(steps) + f"""
select vec_id, cast(k as integer) as cluster, cast(s as bigint) as distance,
  cast(sum(s) over (partition by k) as bigint) as cluster_inertia, cast(sum(s) over () as bigint) as inertia, h as centroid_sha256
from kept join a{rounds} using (r) join names using (k)"""

