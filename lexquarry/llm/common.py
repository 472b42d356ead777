"""What several operators share: row-wise Arrow maps, shared folders, word classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexquarry.session import ensure_checkpoint_dir, release  # noqa: F401 (for the operators here)

#: White space of the word class `[^\x20\x09-\x0D]+`.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def pruned(df: DataFrame, **named: str) -> DataFrame:
    """Only the columns an operator reads, under its own names: extra columns of the input never clash."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{column}`").alias(name) for name, column in named.items()])


def map_columns(df: DataFrame, fn: Callable[..., list], ddl: str, rows: int = 1024) -> DataFrame:
    """Run fn(*columns) -> columns over slices of at most `rows` rows; each column is a Python list.

    Memory is bounded by one slice, whatever the partition holds.
    """
    schema = struct(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def persisted(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder: later jobs survive a lost executor without a rerun."""
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)
