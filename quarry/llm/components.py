"""Connected components of an edge table by alternating stars.

Each round joins every node's neighbours to the smallest of them (large star),
then ties smaller neighbours together (small star). All steps are joins and
aggregations on node ids with map-side minima, so a node with very many
neighbours is split by the skew join and no component is ever in one task.
Rounds grow with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


EDGES_PER_TASK = 100_000


def _large_star(edges: DataFrame, k: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(k)
    return both.join(least, "u").coalesce(k).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(k)


def _small_star(edges: DataFrame, k: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(k)
    tied = edges.join(least, "u").coalesce(k).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(k).distinct().coalesce(k)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Repeated, reversed and looping edges are allowed, edges with a null are
    ignored, and an empty table gives an empty result. Nodes may be of any
    type that orders. The rounds take no more tasks than the edges fill.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v and a is not null and b is not null").distinct())
    k = max(1, -(-now.count() // EDGES_PER_TASK))
    now = now.coalesce(k)
    mark = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now, k), k))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
