"""Connected components.

All loops are Spark joins over edge tables. Each round is written to the shared folder, which cuts the
lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.session import pin, release


def _roots(picks: DataFrame) -> DataFrame:
    """``(u, root)``: follow ``picks(u, root)``, which point to smaller nodes, to their ends by pointer jumping."""
    at = picks
    while True:
        hop = at.select(F.col("u").alias("root"), F.col("root").alias("next"))
        moved = pin(at.join(hop, "root", "left").select("u", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "cc-roots")
        release(at)
        at = moved.drop("moved")
        if not moved.where("moved").head(1):
            return at


def _contractions(edges: DataFrame) -> list[DataFrame]:
    """Rounds of ``(u, root)`` until no edge of the written ``edges(u, v)``, u > v, is left. Each node picks its smallest smaller neighbour and goes into
    the end of its picks, so every round at least halves the nodes that still have edges."""
    rounds = []
    while edges.head(1):
        rounds.append(_roots(pin(edges.groupBy("u").agg(F.min("v").alias("root")), "cc-picks")))
        here = edges.join(rounds[-1].withColumnRenamed("root", "a"), "u").select("a", "v")
        both = here.join(rounds[-1].select(F.col("u").alias("v"), "root"), "v", "left").select("a", F.coalesce("root", "v").alias("b"))
        last, edges = edges, pin(both.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
        release(last)
    release(edges)
    return rounds


def component_labels(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; a component is named by its smallest node.

    First each node ties its smaller neighbours to the smallest of them. Nodes that are nobody's smaller neighbour, most of them in a
    graph with hubs, are then leaves and out of all further steps. What is left is contracted. Neighbour minima are aggregated before the
    shuffle, and joins are against unique keys, so AQE can split a hub.
    """
    pairs = pin(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL"), "cc-pairs")
    picks = pin(pairs.groupBy("u").agg(F.min("v").alias("p")), "cc-picks")
    inner = pin(pairs.select("v").distinct(), "cc-inner")
    tied = pairs.where("u != v").join(picks, "u").where("v != p").select(F.col("v").alias("u"), F.col("p").alias("v"))
    kept = picks.where("u != p").join(inner.withColumnRenamed("v", "u"), "u", "left_semi").select("u", F.col("p").alias("v"))
    rounds = _contractions(pin(tied.unionByName(kept).distinct(), "cc"))
    release(pairs)

    labels = inner.select(F.col("v").alias("node"), F.col("v").alias("component"))
    for step in rounds:
        labels = labels.join(step.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    labels = pin(labels, "cc-labels")
    for step in rounds:
        release(step)
    leaves = picks.join(inner.withColumnRenamed("v", "u"), "u", "left_anti").join(labels.withColumnRenamed("node", "p"), "p")
    return labels.unionByName(leaves.select(F.col("u").alias("node"), "component"))


def star_edges(members: DataFrame, group: str, node: str) -> DataFrame:
    """Edges tying all members of a group to its smallest member: n-1 edges, never all pairs."""
    centre = members.groupBy(group).agg(F.min(node).alias("v"))
    return members.join(centre, group).select(F.col(node).alias("u"), "v").distinct()
