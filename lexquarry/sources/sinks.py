"""Sinks: escaped CSV, sorted JSON recordings, manifests with digests, append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.numbers import spreadsheet_cell


def write_values_csv(rows: DataFrame, path: str) -> None:
    """One row a (document, field), every text cell escaped against formulas."""
    cells = [spreadsheet_cell(F.col(n)).alias(n) if kind == "string" else F.col(n) for n, kind in rows.dtypes]
    rows.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_recording(rows: DataFrame, path: str, keys: list[str]) -> None:
    """One JSON object a line, sorted by the keys over all files."""
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)


def manifest(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, digest: an order-free digest of all rows, for backup and restore checks."""
    out = None
    for name, df in tables.items():
        one = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)").alias("h"))
        one = one.agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("digest")).select(F.lit(name).alias("table"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def changed_terminal_rows(before: DataFrame, after: DataFrame, key: str, terminal: str) -> DataFrame:
    """Keys that were terminal and are gone or changed: an append-only table has none."""
    columns = [c for c in before.columns if c != key]
    digest = lambda df, name: df.select(key, F.xxhash64(*columns).alias(name))
    return digest(before.where(terminal), "old").join(digest(after, "new"), key, "left").where("NOT (old <=> new)").select(key)


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of incoming whose key the table does not hold yet, one a key: what an append may write."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*incoming.columns)
