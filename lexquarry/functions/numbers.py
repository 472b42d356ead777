"""Numeric and cell functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_percentile(rows: DataFrame, key: str, value: str, shares: dict[str, float], places: int) -> DataFrame:
    """`key`, `n` and a column for each share f: the value at the half-even rounded index f * (n - 1) in order.

    Rows are first counted by distinct value; within a key the counts are accumulated over those only.
    """
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy(value)
    placed = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    index = lambda f: F.rint(F.lit(f) * (F.col("n") - 1))
    own = [F.min(F.when(F.col("upto") > index(f), F.col(value))) for f in shares.values()]
    return placed.groupBy(key).agg(F.max("n").alias("n"), *[F.round(v, places).alias(name) for name, v in zip(shares, own)])


def spreadsheet_cell(text: Column) -> Column:
    """An apostrophe in front of what a spreadsheet would take for a formula."""
    risky = text.rlike("^[\\t\\r]") | F.ltrim(text).rlike("^[=+@-]")
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)
