"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.session import ensure_checkpoint_dir


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a 1-based rank in the total order of `order`: a range-partitioned sort, ranks within partitions, and the
    partitions' sizes added up (one row a partition)."""
    ensure_checkpoint_dir(df.sparkSession)
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = parts.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return local.join(F.broadcast(before), "__part").withColumn(name, (F.col("__rn") + F.col("__before")).cast("bigint")).drop("__part", "__rn", "__before", "__n")
