"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantflow.session import cut


def components(links: DataFrame, save: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, root) for every node of `links` (a, b); the root is the smallest reachable node.

    Each round every node points to its smallest neighbour or itself, pointers are followed to
    their ends by doubling, and the edges are contracted along them. Every node that has an edge
    then shares its end with a neighbour, so the nodes left fall at least by half and rounds
    grow with the logarithm of the nodes, without a cap. `save` cuts the lineage of each step; the driver
    only learns whether anything moved.
    """
    edges = save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")))
        while True:
            up = ends.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jumped = save(ends.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            ends = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        to_a, to_b = ends.select(F.col("v").alias("a"), F.col("p").alias("pa")), ends.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        edges = save(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if labels is None:
            labels = ends.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            then = ends.select(F.col("v").alias("root"), F.col("p").alias("next"))
            labels = labels.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return labels
