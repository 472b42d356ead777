"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """`node`, `component` for every node of an edge; component: the smallest node that can be reached.

    edges: columns a and b (bigint). Each round every node points its larger neighbours, then itself and its smaller
    ones, at the least node it knows; the number of rounds follows the logarithm of the longest path. Minima are
    aggregated before they are joined back, so a node with many links is never gathered in one task. Lineage is cut in
    the shared checkpoint folder after every round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    while not _are_stars(e):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = small.select("e.u", "e.v").where("u <> v").distinct().checkpoint()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(e: DataFrame) -> bool:
    """Whether every node is either a root or points at one root only."""
    nodes = e.select(F.col("u").alias("x"), F.lit(1).alias("points"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("points"), F.lit(1).alias("root")))
    return nodes.groupBy("x").agg(F.sum("points").alias("points"), F.max("root").alias("root")).where("points > 1 OR points = 1 AND root = 1").isEmpty()
