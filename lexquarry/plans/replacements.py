"""Replacements and precedence in contracts put together from an order's lines; the statement knows the lines, not the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators import replacement
from lexquarry.session import ensure_checkpoint_dir

from .base import query

AS_OF = "2000-01-01"
_LINES = "SELECT l_orderkey AS o, l_linenumber AS i, min(CAST(l_quantity AS INT)) AS a, min(l_partkey) % 6 AS w, min(l_partkey) % 4 + 1 AS n FROM {source} GROUP BY l_orderkey, l_linenumber"
_CLAUSE = "concat('The notice period is ', a, ' days.')"
_NEW = "concat('The notice period is ', a + 1, ' weeks.')"
_LEADS = ("concat('Clause ', n, ' is hereby deleted and replaced with: “')", "concat('With effect from 2030-01-01, clause ', n, ' is replaced with: “')", "concat('Clause ', n, ' is replaced with: “')")
_TEXT = f"""CASE WHEN i <= 4 THEN concat({_CLAUSE}, ' Other terms stay.') WHEN w = 0 THEN concat({_LEADS[0]}, {_NEW}, '” Fees stay.') WHEN w = 1 THEN concat({_LEADS[1]}, {_NEW}, '”')
  WHEN w = 2 THEN concat('With effect from 1 March 1995, clause ', n, ' is deleted.') WHEN w = 3 THEN concat({_LEADS[2]}, {_NEW}, '” only for orders under Schedule A.')
  WHEN w = 4 THEN 'In case of conflict, this Amendment prevails over these General Terms.' ELSE 'Fees are due.' END"""
_AT_NEW = f"length(CASE w WHEN 0 THEN {_LEADS[0]} WHEN 1 THEN {_LEADS[1]} ELSE {_LEADS[2]} END)"
_ASKS = "element_at(array('What is the notice period?', 'What was originally agreed?', 'What applied in June 2025?', 'What is it now?'), CAST(o % 4 AS INT) + 1)"


def _contracts(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, findings, spans) of every order."""
    one = {"a": "min(CAST(l_quantity AS INT))", "w": "min(l_partkey) % 6", "n": "min(l_partkey) % 4 + 1"}
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("int").alias("i")).agg(*[F.expr(x).alias(k) for k, x in one.items()])
    sections = c.selectExpr("o AS doc_id", "i AS ordinal", "CASE WHEN i <= 4 THEN CAST(i AS STRING) ELSE '' END AS number", "CASE WHEN i <= 4 THEN 'Terms' ELSE 'Amendment No. 1' END AS heading", f"{_TEXT} AS text")
    fifth = c.where("i = 5").selectExpr("o", "a AS a5")
    asked = c.where("i <= 3").join(fifth, "o", "left").selectExpr(
        "o AS doc_id", "CAST(i AS INT) AS finding_id", f"{_ASKS} AS question", "CAST(NULL AS STRING) AS observed",
        "CASE WHEN i = 2 AND o % 2 = 1 AND a5 IS NOT NULL THEN concat('It is ', a5 + 1, ' weeks.') ELSE concat('It is ', a, ' days.') END AS answer",
    )
    own = c.where("i <= 3").selectExpr("o AS doc_id", "CAST(i AS INT) AS finding_id", "i AS ordinal", "0 AS a", f"length({_CLAUSE}) AS b")
    new = c.where("i = 5 AND w IN (0, 1, 3)").selectExpr("o AS doc_id", "2 AS finding_id", "i AS ordinal", f"{_AT_NEW} AS a", f"{_AT_NEW} + length({_NEW}) AS b")
    other = c.where("i = 6").selectExpr("o AS doc_id", "3 AS finding_id", "i AS ordinal", "0 AS a", "10 AS b")
    second, third = (asked.where(f"finding_id = {k}").select("doc_id", "finding_id") for k in (2, 3))
    spans = own.unionByName(new.join(second, ["doc_id", "finding_id"], "left_semi")).unionByName(other.join(third, ["doc_id", "finding_id"], "left_semi"))
    return sections, asked, spans


_SQL = f"""
WITH c AS ({_LINES.format(source="lineitem")}),
f AS (SELECT c.o, c.i AS k, c.a, o % 4 AS asks, f.a5, f.w5, CASE WHEN c.i = 2 AND o % 2 = 1 AND a5 IS NOT NULL THEN a5 + 1 ELSE c.a END AS said FROM c LEFT JOIN (SELECT o, a AS a5, w AS w5 FROM c WHERE i = 5) f USING (o) WHERE c.i <= 3),
r AS (SELECT c.o, c.i, c.w, c.n, c.a + 1 AS b, old.a AS olda FROM c LEFT JOIN c old ON old.o = c.o AND old.i = c.n WHERE c.i >= 5 AND c.w < 4),
t AS (SELECT f.o, f.k, r.i, f.asks, r.w IN (1, 3) AS scoped, olda IS NOT NULL AND r.n = f.k AS old, f.k = 2 AND r.i = 5 AND r.w <> 2 AS new,
  r.w <> 2 AND f.said = r.b AND olda IS DISTINCT FROM r.b AS new_said, olda IS NOT NULL AND f.said = olda AND (r.w = 2 OR olda <> r.b) AS old_said FROM f JOIN r ON r.o = f.o),
e AS (SELECT * FROM t WHERE old OR new)
SELECT o AS doc_id, k::INT AS finding_id, i::INT AS "at", CASE WHEN old AND scoped THEN 'scoped' WHEN asks = 1 OR scoped THEN 'context' WHEN asks = 2 THEN 'dated' WHEN new AND old_said AND NOT new_said THEN 'old_value'
  WHEN NOT old OR new OR new_said THEN 'context' ELSE 'replaced' END AS effect FROM e
UNION ALL SELECT f.o, f.k::INT, p.i::INT, 'precedence' FROM f JOIN c six ON six.o = f.o AND six.i = 6 JOIN c p ON p.o = f.o AND p.i >= 5 AND p.w = 4 WHERE f.k = 3 AND NOT EXISTS (SELECT 1 FROM e WHERE e.o = f.o AND e.k = 3)
"""


@query(_SQL)
def replacement_effects(t) -> DataFrame:
    """What each statement of replacement or precedence means for each finding whose quotes it touches, as of the first day of 2000."""
    ensure_checkpoint_dir(t.spark)
    sections, findings, spans = _contracts(t)
    found, parts = replacement.relations(sections, F.lit(AS_OF).cast("date"))
    return replacement.assess(sections, found.checkpoint(), parts.checkpoint(), findings, spans).select("doc_id", "finding_id", "at", "effect")


@query(f"""WITH c AS ({_LINES.format(source="lineitem")})
SELECT c.o AS doc_id, c.i::INT AS "at", CASE WHEN c.w = 4 THEN 'precedence' ELSE 'replaces' END AS kind, CASE WHEN c.w < 4 THEN c.n::VARCHAR END AS target,
  CASE c.w WHEN 1 THEN 'from 2030-01-01' WHEN 3 THEN 'only for orders under Schedule A' END AS scope, CASE c.w WHEN 2 THEN '1995-03-01' END AS effective, CASE WHEN c.w < 4 THEN old.i::INT END AS old_at,
  CASE WHEN c.w IN (0, 1, 3) THEN 'The notice period is ' || (c.a + 1) || ' weeks.' END AS wording
FROM c LEFT JOIN c old ON old.o = c.o AND old.i = c.n WHERE c.i >= 5 AND c.w < 5""")
def replacement_statements(t) -> DataFrame:
    """Every replacement with its target's place, limits, start and new wording, and every ranking of parts."""
    sections = _contracts(t)[0]
    found, _ = replacement.relations(sections, F.lit(AS_OF).cast("date"))
    rows = found.join(sections.select("doc_id", F.col("ordinal").alias("at"), "text"), ["doc_id", "at"])
    return rows.select("doc_id", "at", "kind", "target", "scope", "effective", "old_at", F.expr("substring(text, new_start + 1, new_stop - new_start)").alias("wording"))
