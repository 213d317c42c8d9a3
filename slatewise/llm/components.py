"""Connected components of a graph of any size, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours of each node on the least one: the larger neighbours, or the smaller ones with the node."""
    if larger:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        found = sides.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        found = (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
    return found.where("u != v").distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether every node hangs on one root directly: no node has two edges down, or edges both up and down."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    uses = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not uses.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).take(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node it reaches.

    edges: columns u and v, both long, in either direction, repeated or not. Stars
    over larger and then over smaller neighbours alternate until every node hangs
    on its root directly, which takes a number of rounds that grows with the logarithm of the graph.
    Each round is stored, so no lineage grows.
    """
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                 "edges")
    while not _flat(now):
        now = stored(_stars(_stars(now, True), False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
