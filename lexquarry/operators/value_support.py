"""Typed values over DataFrames: facts, the anti-join of an answer's values with its quotes, claims about every party."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexquarry.functions import typed_values as values

VALUES = "place int, start int, stop int, surface string, value_key string, kind string, base string"
#: Texts whose values are sent on together.
ROWS = 1024
CLAIMS = "array<struct<kind:string,used:string,offered:string>>"


def _mapped(df: DataFrame, key: list[str], read: list[Column], out: str, fn: Callable) -> DataFrame:
    """key columns and one column fn(*read), equal values read once a batch."""
    rows = df.select(*key, *[c.alias(f"__{k}") for k, c in enumerate(read)])
    schema = T.StructType(rows.schema.fields[: len(key)] + T.StructType.fromDDL(out).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}
            found = []
            for given in zip(*[c.to_pylist() for c in batch.columns[len(key) :]]):
                at = repr(given)
                if at not in known:
                    known[at] = fn(*given)
                found.append(known[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(found, type=arrow[-1].type)], schema=arrow)

    return rows.mapInArrow(run, schema)


def stated_values(df: DataFrame, key: list[str], text: str, answer: bool = False) -> DataFrame:
    """key, `place` (from 1, in the text's order), start, stop, surface, value_key, kind, base."""

    rows = df.select(*key, F.col(text).alias("__text"))
    schema = T.StructType(rows.schema.fields[: len(key)] + T.StructType.fromDDL(VALUES).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(key)).to_pylist()
            for start in range(0, len(texts), ROWS):
                found = [values.rows_in(t or "", answer) for t in texts[start : start + ROWS]]
                owner = pa.array([k for k, rows in enumerate(found, start) for _ in rows], type=pa.int64())
                place = [k for rows in found for k in range(1, len(rows) + 1)]
                columns = list(zip(*[row for rows in found for row in rows])) or [()] * 6
                yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in batch.columns[: len(key)]], *[pa.array(v, type=f.type) for v, f in zip([place, *columns], list(arrow)[len(key) :])]], schema=arrow)

    return rows.mapInArrow(run, schema)


def _support(found: DataFrame, key: list[str]) -> DataFrame:
    """key, `mark`: what values of a text support. A value supports its number as its own kind and as no kind, one of no
    kind supports it as any, and one with a base supports the same base."""
    plain = F.col("kind") == "plain"
    marks = F.array(F.concat("value_key", F.lit("|plain")), F.concat("value_key", F.lit("|"), F.when(plain, "any").otherwise(F.col("kind"))), F.concat(F.lit("="), "base"))
    return found.select(*key, F.explode(F.array_compact(marks)).alias("mark")).distinct()


def _asks(found: DataFrame) -> Column:
    """The marks of which one supports an answer's value."""
    plain = F.col("kind") == "plain"
    own = F.when(~plain, F.concat("value_key", F.lit("|"), "kind"))
    return F.array_compact(F.array(F.when(plain, F.concat("value_key", F.lit("|plain"))), own, F.when(~plain, F.concat("value_key", F.lit("|any"))), F.concat(F.lit("="), "base")))


def unquoted_values(answers: DataFrame, quotes: DataFrame, key: list[str], standards: DataFrame | None = None) -> DataFrame:
    """key, place, surface, value_key, kind: values that an answer states and no quote of its key does.

    answers: key, text. quotes: key, text, any number a key. standards: the same for texts that set a standard, which
    support a value only where the answer also states a value of its kind that a quote states. Support is by the same
    number as the same kind or with a kind on one side only, or by the same value in the family's base unit; all of it is
    equi-joins on marks, so no pair of unlike values meets. A value stated twice is reported at its first place.
    """
    said = stated_values(answers, key, "text", answer=True)
    asked = said.withColumn("mark", F.explode(_asks(said)))
    held = lambda texts: asked.join(_support(stated_values(texts, key, "text"), key), [*key, "mark"], "left_semi").select(*key, "place", "kind").distinct()
    quoted = held(quotes)
    supported = quoted.select(*key, "place")
    if standards is not None:
        family = F.when(F.col("kind").isin("clock", "days", "months"), "duration").otherwise(F.col("kind"))
        compared = quoted.select(*key, family.alias("family")).distinct()
        supported = supported.unionByName(held(standards).withColumn("family", family).join(compared, [*key, "family"], "left_semi").select(*key, "place")).distinct()
    missing = said.join(supported, [*key, "place"], "left_anti")
    return missing.groupBy(*key, "value_key", "kind").agg(F.min(F.struct("place", "surface")).alias("first")).select(*key, "first.place", "first.surface", "value_key", "kind")


def uniform_claims(df: DataFrame, key: list[str], answer: str, quotes: str) -> DataFrame:
    """key, kind, used, offered: statements that give every party one of several values that its quotes (an array) offer."""

    def read(said: str | None, passages: list[str] | None):
        return [{"kind": k, "used": u, "offered": o} for k, u, o in values.uniform_claims(said, [q for q in passages or [] if q])]

    found = _mapped(df, key, [F.col(answer), F.col(quotes)], f"found {CLAIMS}", read)
    return found.select(*key, F.explode("found").alias("c")).select(*key, "c.kind", "c.used", "c.offered")
