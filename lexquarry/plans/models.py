"""Vectors of whole texts by a provider, sealed records, and what changed between neighbouring documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators import providers, textdiff

from .base import query

DIMS = 64


@query(f"""
WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM documents)
SELECT doc_id, (('0x' || h[1:4])::INT % {DIMS})::INT AS dim, sum(CASE WHEN h[5] < '8' THEN 1 ELSE -1 END)::BIGINT AS value FROM w GROUP BY 1, 2 HAVING value <> 0
""")
def document_vectors(t) -> DataFrame:
    """Every document's hashed word vector, its dimensions that are not 0: a model made once a worker, called in batches."""
    found = providers.embed(t.documents, ["doc_id"], "text", f"hashed words {DIMS}", lambda: providers.HashedWords(DIMS))
    each = found.select("doc_id", F.posexplode("vector").alias("dim", "value")).where("value <> 0")
    return each.groupBy("doc_id", "dim").agg(F.sum("value").cast("bigint").alias("value")).where("value <> 0")


@query()
def neighbour_changes(t) -> DataFrame:
    """Lines that a document shares in order with the next id's, and those that only one has."""
    after = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new"))
    return textdiff.line_changes(t.documents.select("doc_id", F.col("text").alias("old")).join(after, "doc_id"), ["doc_id"], "old", "new")
