"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import common


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs to (node, component): the smallest node that can be reached, for every node with a link.

    Each round, every node joins the smallest of itself and its neighbours, and links move to what their ends joined.
    A node that isn't smaller than all its neighbours goes, so half the nodes at least go with every round. Rounds are
    written tables; minima are aggregated before they shuffle, and hot nodes are split by the adaptive skew join.
    """
    edges = common.materialise(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joins = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), "cc-joins")
        rounds.append(joins)
        left = edges.join(joins.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        moved = left.join(joins.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        before, edges = edges, common.materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-links")
        common.drop(before)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    label = rounds[0].select("node", F.col("to").alias("component"))
    for joins in rounds[1:]:
        step = joins.select(F.col("node").alias("component"), "to")
        label = label.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = common.materialise(label, "cc-labels")
    common.drop(edges, *rounds)
    return out
