"""Connected components by alternating large and small stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang each node's larger (``small``: not larger) neighbours on the least node around it."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:  # a is the larger end
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    hung = both.join(least, "a")
    if small:
        moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    else:
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for the nodes of ``edges`` (a, b).

    Rounds grow with the logarithm of a component's size.  A node with very many edges is reduced by
    partial minima and met in an equi-join, so nothing gathers its neighbours.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))).first()
        if tuple(found) == state or not found[0]:
            break
        state = tuple(found)
        now = cut(_star(_star(now, small=False), small=True))
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
