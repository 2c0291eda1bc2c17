"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b of any one orderable type) -> (node, root): root is the smallest node that can be reached.

    Every node of an edge gets one row; loops and repeated edges are harmless, edges with a null end are ignored.
    A round points each node's larger neighbours at its smallest one, then its smaller neighbours; the number of
    rounds grows with the logarithm of the number of nodes. Each round is two partial aggregations and two joins
    on the node, whose one-row-per-node side lets the adaptive planner split a hub. Rounds end in a stored table.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = store(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(2**40))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        links = store(_small_star(_large_star(links)), "links")
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    return both.join(least, both.u == least.c).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    moved = links.join(least, links.u == least.c).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("c", "m")).distinct()
