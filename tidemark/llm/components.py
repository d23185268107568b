"""Connected components of an edge table by alternating large and small stars.

Every round is a few aggregations and joins and ends in a written table; nothing
is collected.  The result maps each node to the smallest node it can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

MAX_ROUNDS = 60


def large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's smallest neighbour, or to the node."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these; edges are (larger, smaller)."""
    e = e.where("a <> b").distinct()
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), in any order and with repeats, to (node, root) for all nodes but the roots."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            return e.toDF("node", "root")
        mark = tuple(now)
        e = written(small_star(large_star(e)))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
