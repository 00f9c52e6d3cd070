"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import cut


def _least_neighbour(links: DataFrame) -> DataFrame:
    """node, least: the smallest of a node and its neighbours (``links`` holds both directions)."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (u, v); the component is its smallest node.

    Large star: a node hands the smallest neighbour to its larger neighbours.  Small star: a
    node and its smaller neighbours all point to the smallest of them.  Both keep the
    components and end in stars around the smallest nodes.  Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest chain.
    Sums per node merge before the shuffle, and joins let adaptive execution split hot nodes.
    """
    down = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(down)
    while state[0]:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = down.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = larger.join(_least_neighbour(both), "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        # Nodes without a smaller neighbour but themselves keep their links through the larger end.
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            least.select("u", F.col("least").alias("v")))
        down = cut(small.where("u <> v").distinct(), "links")
        new = _state(down)
        if new == state:
            break
        state = new
    ends = down.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
