"""Connected components of a link table, by neighbours and minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (left, right) links; component is its smallest node.

    Each round every node points at the smallest node it sees: large neighbours are handed to the
    smallest one, then each node's small neighbours to their smallest (the alternating star
    rounds of Kiveris et al.), which ends after a number of rounds that grows with the
    logarithm of the number of links. Every round is written to the shared folder. No group is
    ever gathered in one task: each round only takes minima per node.
    """
    edges = stored(links.filter(F.col("left") != F.col("right")).select(
        F.greatest("left", "right").alias("u"), F.least("left", "right").alias("v")).distinct(), "edges")
    if edges.isEmpty():
        return links.select(F.col("left").alias("node"), F.col("left").alias("component")).filter(F.lit(False))
    while True:
        after = stored(_small_star(_large_star(edges)), "edges")
        changed = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        edges = after
        if changed:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    down = edges.filter(F.col("u") > F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = (down.join(least, "u").filter(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
