"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every round is a minimum per node (a partial aggregate) and an equi-join, so a node with very many neighbours is never
gathered in one place. The method is that of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisframe.runtime import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id connected with each node that has an edge. ``edges`` has columns a, b."""
    both = edges.where("a <> b").select("a", "b")
    current = checkpointed(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        state = tuple(state.first())
        if state == before:
            break
        before = state
        current = checkpointed(_small_star(_large_star(current)))
    labels = current.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    centres = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return labels.unionByName(centres.join(labels, "id", "left_anti"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    around = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(
        edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
    least = around.groupBy("n").agg(F.least(F.min("w"), F.col("n")).alias("m"))
    linked = around.where("w > n").join(least, "n").select(F.col("w").alias("u"), F.col("m").alias("v"))
    return linked.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()
