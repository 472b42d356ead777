"""A Python reading of columns, once for each distinct row of a batch and for as long as its worker remembers it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows whose readings a task remembers beyond their batch.
REMEMBERED = 20_000


def first_places(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of each distinct row, which of these each row equals)."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        coded = column.dictionary_encode()
        own = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        # renumbered after every column, so codes stay below the batch's rows
        code = np.unique(code * (len(coded.dictionary) + 1) + own, return_inverse=True)[1]
    return np.unique(code, return_index=True, return_inverse=True)[1:]


def by_distinct(df: DataFrame, key: list[str], read: list[str], ddl: str, fn: Callable) -> DataFrame:
    """key columns and what fn (a tuple) gives for the columns `read`, of plain types; only distinct ones become Python values."""
    rows = df.select(*key, *[F.col(c).alias(f"__{k}") for k, c in enumerate(read)])
    schema = T.StructType(rows.schema.fields[: len(key)] + T.StructType.fromDDL(ddl).fields)
    arrow = to_arrow_schema(schema)
    made = list(arrow)[len(key) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            given = batch.columns[len(key) :]
            first, which = first_places(given)
            at = pa.array(first)
            if len(known) > REMEMBERED:
                known.clear()
            out = []
            for one in zip(*[c.take(at).to_pylist() for c in given]):
                if one not in known:
                    known[one] = fn(*one)
                out.append(known[one])
            back = pa.array(which.reshape(-1))
            found = [pa.array(v, type=f.type).take(back) for v, f in zip(zip(*out), made)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], *found], schema=arrow)

    return rows.mapInArrow(run, schema)
