"""Depth of each node in a forest of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.session import ensure_checkpoint_dir


def depths(edges: DataFrame) -> DataFrame:
    """edges (k, up), one a node -> k, root, depth. Every round each node jumps to where its ancestor had come, and adds the way.

    A way is as long as there are nodes at most: who still moves when the jumps are longer is in a cycle or leads to one,
    and has no root and no depth.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    state = edges.select("k", F.col("up").alias("at"), F.lit(1).cast("bigint").alias("depth")).checkpoint()
    nodes, jump = state.count(), 1
    while True:
        ahead = state.select(F.col("k").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        state = state.join(ahead, "at", "left").select("k", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")).checkpoint()
        jump *= 2
        if jump > 2 * nodes or state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("k", F.when(~F.col("moved"), F.col("at")).alias("root"), F.when(~F.col("moved"), F.col("depth")).alias("depth"))
