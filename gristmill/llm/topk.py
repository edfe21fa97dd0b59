"""Exact top-k by inner product over norm-sorted blocks of vectors.

Vectors are scaled to whole numbers, sorted by descending length and stored in blocks; every block
also knows its vectors in the basis of the right singular vectors of all of them, where the first
coordinates hold most of each length.  A block is met by blocks of queries.  A pair of blocks is
dropped when the product of lengths cannot reach a query's k-th best so far (Cauchy-Schwarz); inside
a pair, partial sums over leading coordinates plus the product of the residual lengths bound each
score, and only candidates whose bound reaches the k-th best are scored, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import cut, numbered

SCALE = 256
BLOCK = 4096  # vectors of a block
QUERY_BLOCK = 512
STEPS = (0.25, 0.5)  # shares of the coordinates after which candidates are pruned
_SLACK = 1e-6  # relative; rotation is in floating point, so bounds are widened by it

BLOCK_SCHEMA = "block long, length double, n int, ids binary, components binary"
SCORES = "query_id long, vec_id long, score long"


def _scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, components (array of longs) and length of the vectors that take part; equal rows once."""
    bad = F.exists(
        F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & ~bad)
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("__v")).distinct()
    rows = rows.select("vec_id", _scaled(F.col("__v")).alias("components"))
    square = F.aggregate("components", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.withColumn("length", F.sqrt(square))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), width), dtype=np.int64)
    sizes = np.diff(np.concatenate([[0], ends]))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def _packed(width: int):
    """Rows of one block number (successive rows of the input) as one row of matrices."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = None

        def block() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            ids = part.column("vec_id").to_numpy()
            values = _matrix(part.column("components").combine_chunks(), width)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([float(part.column("length")[0].as_py())]),
                    pa.array([len(ids)], pa.int32()),
                    pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                    pa.array([values.astype("<i8").tobytes()], pa.binary()),
                ],
                names=["block", "length", "n", "ids", "components"],
            )

        for batch in batches:
            numbers = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for start, end in zip(cuts, cuts[1:]):
                if end > start:
                    if held and numbers[start] != number:
                        yield block()
                        held = []
                    number = int(numbers[start])
                    held.append(batch.slice(start, end - start))
        if held:
            yield block()

    return run


def _blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """``rows`` by descending length in blocks of ``size``, however they are partitioned."""
    placed = numbered(rows, [F.desc("length"), F.col("vec_id")], "place")
    placed = placed.withColumn("block", F.floor(F.col("place") / F.lit(size)))
    dealt = placed.repartition("block").sortWithinPartitions("block", "place").drop("place")
    return dealt.mapInArrow(_packed(width), BLOCK_SCHEMA)


def _gram(width: int):
    """Sum of outer products of a partition: at most width x width numbers per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("components"), width).astype(float)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"]
        )

    return run


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, strongest first, from the summed outer products."""
    sums = rows.select("components").mapInArrow(_gram(width), "i long, j long, v double")
    gram = np.zeros((width, width))
    for r in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # width x width numbers
        gram[r["i"], r["j"]] = r["v"]
    values, vectors = np.linalg.eigh(gram)
    return vectors[:, np.argsort(-values)]


def _unpack(n: int, ids: bytes, components: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(components, "<i8").reshape(n, width)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise whole-number inner products of two equally long matrices."""
    return np.einsum("ij,ij->i", a, b)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _meet(width: int, turn: np.ndarray, k: int):
    """Score pairs of blocks: up to k candidates of the block for each of the queries."""
    cuts = sorted({max(1, int(width * s)) for s in STEPS})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for row in batch.to_pylist():
                q_ids, q = _unpack(row["q_n"], row["q_ids"], row["q_components"], width)
                v_ids, v = _unpack(row["n"], row["ids"], row["components"], width)
                floors = row["floors"]
                qr, vr = q @ turn, v @ turn
                q_len, v_len = np.sqrt((qr * qr).sum(1)), np.sqrt((vr * vr).sum(1))
                slack = _SLACK * (1 + q_len.max() * v_len.max())
                rest = [(np.sqrt((qr[:, c:] ** 2).sum(1)), np.sqrt((vr[:, c:] ** 2).sum(1))) for c in cuts]
                first = qr[:, : cuts[0]] @ vr[:, : cuts[0]].T
                bound = first + rest[0][0][:, None] * rest[0][1][None, :]
                for i in range(len(q_ids)):
                    need = -np.inf if floors is None or floors[i] is None else floors[i]
                    if q_len[i] * v_len[0] + slack < need:  # sorted by length: no vector can reach it
                        continue
                    # raise the floor with the most promising candidates of this block
                    lead = np.argpartition(-bound[i], min(4 * k, len(v_ids) - 1))[: 4 * k]
                    lead = lead[v_ids[lead] != q_ids[i]]
                    if len(lead) >= k:
                        need = max(need, np.partition(v[lead] @ q[i], -k)[-k])
                    left = np.flatnonzero(bound[i] + slack >= need)
                    partial = first[i, left]
                    for a, b, (qs, vs) in zip(cuts, cuts[1:], rest[1:]):
                        partial = partial + vr[left, a:b] @ qr[i, a:b]
                        keep = partial + qs[i] * vs[left] + slack >= need
                        left, partial = left[keep], partial[keep]
                    left = left[v_ids[left] != q_ids[i]]
                    scores = v[left] @ q[i]
                    top = _best(v_ids[left], scores, k)
                    top = top[scores[top] >= need]
                    out.append((np.full(len(top), q_ids[i]), v_ids[left][top], scores[top]))
            columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"]
            )

    return run


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _spread_ids():
    """(q_block, place, query_id, length) of each query of a block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["q_ids"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), row["q_block"])), pa.array(np.arange(len(ids))), pa.array(ids)],
                    names=["q_block", "place", "query_id"],
                )

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` highest whole-number inner products.

    ``is_query`` says which rows are queries; candidates are all rows but the query's own id.
    First every query block meets the block of the longest vectors, which gives each query a floor;
    then it meets the other blocks whose longest vector could still reach one of its floors.  Blocks
    are rows of fixed size, so a task holds two of them and no group of vectors is ever gathered;
    equal vectors are no hot key.  The driver holds width x width numbers.

    Null vectors, null ids and vectors with null or non-finite components take no part; shorter
    vectors count as filled with zeros; ties go to the smaller id; rows that repeat an id
    with other vectors are candidates of their own (rows equal in both count once), and the scores of a
    repeated query id are ranked together; fewer candidates than ``k`` give fewer rows; an empty table
    gives no rows; other columns are ignored.  Scores must fit 64 bits.
    """
    rows = cut(usable(vectors, key, vector))
    width = rows.agg(F.max(F.size("components"))).first()[0] or 1
    turn = rotation(rows, width)
    blocks = cut(_blocks(rows, width, block).withColumnRenamed("block", "v_block"))
    q_blocks = cut(
        _blocks(rows.where(is_query), width, query_block).select(
            F.col("block").alias("q_block"),
            F.col("length").alias("q_length"), F.col("n").alias("q_n"),
            F.col("ids").alias("q_ids"), F.col("components").alias("q_components"),
        )
    )
    meet = _meet(width, turn, k)
    columns = ["q_n", "q_ids", "q_components", "n", "ids", "components", "floors"]

    # block 0 holds the longest vectors
    seed = q_blocks.withColumn("v_block", F.lit(0).cast("long")).join(blocks, "v_block")
    seeded = cut(seed.withColumn("floors", F.lit(None).cast("array<long>")).select(*columns).mapInArrow(meet, SCORES))
    floor = _ranked(seeded, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    places = q_blocks.select("q_block", "q_ids").mapInArrow(_spread_ids(), "q_block long, place long, query_id long")
    in_order = F.array_sort(F.collect_list(F.struct("place", "floor")))  # as many as a block has queries
    floors = (
        places.join(floor, "query_id", "left")
        .groupBy("q_block")
        .agg(
            F.transform(in_order, lambda x: x["floor"]).alias("floors"),
            F.min(F.coalesce("floor", F.lit(-(1 << 63)))).alias("least"),
        )
    )
    q_blocks = cut(q_blocks.join(floors, "q_block"))

    # each block meets the query blocks it can still matter to: a range of lengths, not all of them
    pairs = blocks.where("v_block > 0").select("v_block", "length").join(
        q_blocks.select("q_block", "q_length", "least"),
        F.col("length") * F.col("q_length") * (1 + _SLACK) + 1 >= F.col("least"),
    )
    rest = (
        pairs.select("v_block", "q_block")
        .join(q_blocks.drop("q_length", "least"), "q_block")
        .join(blocks.drop("length"), "v_block")
        .select(*columns)
        .mapInArrow(meet, SCORES)
    )
    best = _ranked(seeded.unionByName(rest), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_sql(k: int = 5, every: int = 50) -> str:
    """The same rows by scoring every pair."""
    return f"""
with v as (select vec_id, [floor({SCALE} * x::double) for x in embedding] as c from embeddings
  where embedding is not null and vec_id is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.c, v.c)::bigint as score
  from v q join v on v.vec_id <> q.vec_id where q.vec_id % {every} = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {k}"""
