"""Connected parts of a graph whose node numbers are hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hunkmill.session import landed


def connected(edges: DataFrame) -> DataFrame:
    """(node, part) of all nodes of the edges (a, b); the part is the number of one of its nodes.

    Each round every node joins its smallest neighbour and the edges are drawn between what is left.
    As the numbers are hashes, a constant share of the nodes goes in each round, also in chains.
    Rounds are written to the shared folder; no graph is ever held by the driver.
    """
    left = landed(edges.where("a <> b").distinct(), "edges")
    nodes, rounds = None, 0
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = landed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("part")), "joined")
        if nodes is None:
            nodes = joined.select(F.col("a").alias("node"), "part")
        else:
            later = joined.select(F.col("a").alias("part"), F.col("part").alias("next"))
            nodes = nodes.join(later, "part", "left").select("node", F.coalesce("next", "part").alias("part"))
        ends = left.join(joined, "a").select(F.col("part").alias("x"), F.col("b").alias("a"))
        ends = ends.join(joined, "a").select(F.col("x").alias("a"), F.col("part").alias("b"))
        left = landed(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        rounds += 1
        if rounds % 4 == 0:
            nodes = landed(nodes, "nodes")
    if nodes is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("part"))
    return landed(nodes, "nodes")
