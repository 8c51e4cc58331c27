"""Connected components by alternating star contraction.

In a large-star step every node sends its larger neighbours to the least node that it
knows, in a small-star step its smaller ones and itself (Kiveris et al., 2014). Both keep
the components and end in stars around the least nodes, after a number of rounds that grows
with the logarithm of the graph. Neighbours are never gathered: a step is one combined
minimum per node, joined back. Each round is stored, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def is_starry(edges: DataFrame) -> bool:
    """Whether every larger end has one link and is nobody's smaller end: then all links lead to the least nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"))
    )
    odd = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n")).where("ups > 0 and n > 1")
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for all nodes of ``edges(u, v)`` but the least ones themselves.

    Self-links and repeated links do no harm; null ends are passed over; no edges give no rows.
    """
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    at = staged(down.distinct(), "edges")
    while not is_starry(at):
        at = staged(small_star(large_star(at)).distinct(), "edges")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component"))
