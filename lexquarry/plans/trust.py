"""What a revision reaches: aligning two versions by content, and counting only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.text import SQL_SECTIONS, sections
from lexquarry.operators.alignment import align_versions

from .base import query

_SQL_VERSIONS = f"""{SQL_SECTIONS}, old AS (SELECT doc_id, ordinal, text, sha256(text) AS k FROM sections),
new AS (SELECT doc_id, ordinal, CASE WHEN ordinal % 5 = 4 THEN text || ' as amended' ELSE text END AS text FROM sections WHERE ordinal % 7 <> 3
UNION ALL SELECT doc_id, 100000 + ordinal, 'new clause ' || doc_id FROM sections WHERE ordinal = 0), newk AS (SELECT *, sha256(text) AS k FROM new)"""


def versions(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections of a document and of a derived revision: every seventh dropped, every fifth amended, one added."""
    old = sections(documents)
    amended = F.when(F.col("ordinal") % 5 == 4, F.concat("text", F.lit(" as amended"))).otherwise(F.col("text"))
    new = old.where("ordinal % 7 <> 3").withColumn("text", amended)
    added = old.where("ordinal = 0").select("doc_id", (F.col("ordinal") + 100000).alias("ordinal"), F.concat(F.lit("new clause "), F.col("doc_id").cast("string")).alias("text"))
    return old.withColumn("k", F.sha2("text", 256)), new.unionByName(added).withColumn("k", F.sha2("text", 256))


@query(f"""
WITH {_SQL_VERSIONS}, o AS (SELECT doc_id, k, count(*) AS n FROM old GROUP BY 1, 2), w AS (SELECT doc_id, k, count(*) AS n FROM newk GROUP BY 1, 2)
SELECT coalesce(o.doc_id, w.doc_id) AS doc_id, sum(CASE WHEN w.k IS NOT NULL THEN coalesce(o.n, 0) ELSE 0 END)::BIGINT AS identical,
sum(CASE WHEN w.k IS NULL THEN o.n ELSE 0 END)::BIGINT AS gone, sum(CASE WHEN o.k IS NULL THEN w.n ELSE 0 END)::BIGINT AS fresh
FROM o FULL JOIN w ON o.doc_id = w.doc_id AND o.k = w.k GROUP BY 1
""")
def section_align_exact(t) -> DataFrame:
    """Sections of each document that stay, go and come, by content key."""
    old, new = versions(t.documents)
    count = lambda df, name: df.groupBy("doc_id", "k").agg(F.count("*").alias(name))
    both = count(old, "o").join(count(new, "w"), ["doc_id", "k"], "full")
    zero = F.lit(0)
    return both.groupBy("doc_id").agg(
        F.sum(F.when(F.col("w").isNotNull(), F.coalesce("o", zero)).otherwise(0)).alias("identical"),
        F.sum(F.when(F.col("w").isNull(), F.col("o")).otherwise(0)).alias("gone"),
        F.sum(F.when(F.col("o").isNull(), F.col("w")).otherwise(0)).alias("fresh"),
    )


def _hits(text: str):
    return ((F.length(text) - F.length(F.replace(F.col(text), F.lit("er"), F.lit("")))) / 2).cast("bigint")


@query(f"""
WITH {_SQL_VERSIONS}, kept AS (SELECT DISTINCT doc_id, k FROM old),
c AS (SELECT n.doc_id, (length(text) - length(replace(text, 'er', ''))) // 2 AS hits, kept.k IS NOT NULL AS stored FROM newk n LEFT JOIN kept ON kept.doc_id = n.doc_id AND kept.k = n.k)
SELECT doc_id, count(CASE WHEN stored THEN 1 END)::BIGINT AS reused, count(CASE WHEN NOT stored THEN 1 END)::BIGINT AS searched, sum(hits)::BIGINT AS places FROM c GROUP BY doc_id
""")
def recount_incremental(t) -> DataFrame:
    """Places in the revision: stored counts for sections that stay, a search of the others only."""
    old, new = versions(t.documents)
    stored = old.groupBy("doc_id", "k").agg(F.first(_hits("text")).alias("known"))
    joined = new.join(stored, ["doc_id", "k"], "left")
    hits = F.when(F.col("known").isNotNull(), F.col("known")).otherwise(_hits("text"))
    return joined.groupBy("doc_id").agg(F.count("known").alias("reused"), F.count_if(F.col("known").isNull()).alias("searched"), F.sum(hits).alias("places"))


@query(f"""
WITH {_SQL_VERSIONS}, o AS (SELECT doc_id, k, count(*) AS n FROM old GROUP BY 1, 2), w AS (SELECT DISTINCT doc_id, k FROM newk),
v AS (SELECT o.doc_id, CASE WHEN w.k IS NOT NULL AND o.n = 1 THEN 'unchanged' WHEN w.k IS NOT NULL THEN 'revalidated' ELSE 'stale' END AS verdict, o.n FROM o LEFT JOIN w ON o.doc_id = w.doc_id AND o.k = w.k)
SELECT verdict, count(*)::BIGINT AS keys, sum(n)::BIGINT AS sections FROM v GROUP BY verdict
""")
def finding_verdicts(t) -> DataFrame:
    old, new = versions(t.documents)
    both = old.groupBy("doc_id", "k").agg(F.count("*").alias("n")).join(new.select("doc_id", "k", F.lit(True).alias("there")).distinct(), ["doc_id", "k"], "left")
    verdict = F.when(F.col("there") & (F.col("n") == 1), "unchanged").when(F.col("there"), "revalidated").otherwise("stale")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("keys"), F.sum("n").alias("sections"))


@query(f"""
WITH {_SQL_VERSIONS}, req AS (SELECT doc_id, ordinal % 3 AS finding, bool_and(length(text) > 20) AS quoted, bool_or(ordinal = 0) AS cited FROM sections GROUP BY 1, 2)
SELECT doc_id, finding::INT AS finding, CASE WHEN quoted AND cited THEN 'held' WHEN quoted THEN 'uncited' ELSE 'open' END AS state FROM req
""")
def obligation_states(t) -> DataFrame:
    """State of each finding from its proof obligations: all of the one kind, any of the other."""
    req = sections(t.documents).groupBy("doc_id", (F.col("ordinal") % 3).alias("finding")).agg(F.bool_and(F.length("text") > 20).alias("quoted"), F.bool_or(F.col("ordinal") == 0).alias("cited"))
    return req.select("doc_id", "finding", F.when(F.col("quoted") & F.col("cited"), "held").when(F.col("quoted"), "uncited").otherwise("open").alias("state"))


@query()
def section_alignment(t) -> DataFrame:
    """Each old section's counterpart in the revision and the pass that found it."""
    old, new = versions(t.documents)
    heading = F.substring_index("text", " ", 3)
    shape = lambda df: df.select("doc_id", "ordinal", F.lit("").alias("number"), heading.alias("heading"), "text", "k")
    return align_versions(shape(old), shape(new))
