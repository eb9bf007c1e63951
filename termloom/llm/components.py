"""Connected components of an edge table, by smallest number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import stored


def _plain(edges: DataFrame, a: Column, b: Column) -> DataFrame:
    """Edges between different ends, smaller end first, each once."""
    return stored(edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")


def _roots(edges: DataFrame) -> DataFrame:
    """``node, root``: every end hooked to its smallest neighbour below it, and so on down to a root."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root")
    ), "roots")
    while True:
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(roots.join(jump, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        roots = new.select("node", "root")
        if new.filter("moved").isEmpty():
            return roots


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``edges(a, b)``: the smallest node reachable.

    Rounds of hooking and contraction, each a stored table: nodes go to a root,
    and only edges between different roots stay for the next round. At least half
    of the nodes that still have an edge go in a round, so all rounds together
    move a few times the edges. Minima are pre-aggregated, so a hub's neighbours
    never meet in one task.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = stored(nodes.select("node", F.col("node").alias("component")), "labels")
    edges = _plain(edges, F.col("a"), F.col("b"))
    while not edges.isEmpty():
        roots = _roots(edges)
        named = roots.select(F.col("node").alias("component"), "root")
        labels = stored(labels.join(named, "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")
        ), "labels")
        ends = edges
        for side in ("a", "b"):
            ends = ends.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side)
        edges = _plain(ends, F.col("a_root"), F.col("b_root"))
    return labels
