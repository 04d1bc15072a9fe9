"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a join and an aggregation over edges; nothing is gathered by node, and each round is written to the
shared folder, so lineage stays short. The loop ends when every edge leads to a root that has no parent; it has
no limit on rounds (their number is logarithmic in the longest path in practice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """edges (u, v), any order, repeats and loops allowed -> (node, root) for each node that has an edge; root: the least node."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, k = work.write(ordered, "edges-0"), 0
    while not now.join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() or k == 0:
        k += 1
        following = work.write(small_star(large_star(now)), f"edges-{k}")
        work.drop(f"edges-{k - 1}")
        now = following
    children = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return children.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
