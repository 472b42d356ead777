"""Text structure: furniture, headings, clauses, definitions, references, sentences, invisible characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.text import SQL_SECTIONS, sections
from lexquarry.operators.sectioning import build_sections, read_documents

from .base import query


def _order():
    return Window.partitionBy("doc_id").orderBy("ordinal")


@query(f"""
WITH {SQL_SECTIONS}, page AS (SELECT source, s.doc_id, trim(s.text) AS line, s.ordinal FROM sections s JOIN documents USING (doc_id)), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM page GROUP BY 1),
f AS (SELECT source, line, count(DISTINCT doc_id) AS on_pages FROM page GROUP BY 1, 2) SELECT source, line, on_pages::BIGINT AS on_pages FROM f JOIN n USING (source) WHERE on_pages >= 3 AND on_pages > pages / 20.0
""")
def furniture_lines(t) -> DataFrame:
    """Lines that stand on three pages and on a share of all pages of a source."""
    page = sections(t.documents).join(t.documents.select("doc_id", "source"), "doc_id").select("source", "doc_id", F.trim("text").alias("line"))
    n = t.documents.where(F.col("text").rlike("[^\\s]")).groupBy("source").agg(F.countDistinct("doc_id").alias("pages"))
    lines = page.distinct().groupBy("source", "line").agg(F.count("*").alias("on_pages"))
    return lines.where("on_pages >= 3").join(n, "source").where("on_pages > pages / 20.0").select("source", "line", "on_pages")


@query(f"""
WITH {SQL_SECTIONS}, e AS (SELECT doc_id, ordinal, trim(text) AS line, CASE WHEN ordinal < 2 THEN 'top' END AS edge,
row_number() OVER (PARTITION BY doc_id ORDER BY ordinal DESC) AS back FROM sections), x AS (SELECT regexp_replace(line, '[0-9]+', '#', 'g') AS shape, doc_id FROM e WHERE edge = 'top' OR back <= 2)
SELECT shape, count(DISTINCT doc_id)::BIGINT AS pages FROM x GROUP BY shape HAVING count(DISTINCT doc_id) >= 3
""")
def edge_furniture(t) -> DataFrame:
    """First and last two lines of each page, digits unified, that stand on three pages."""
    back = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("ordinal")))
    e = sections(t.documents).withColumn("back", back).where("ordinal < 2 OR back <= 2")
    shapes = e.select(F.regexp_replace(F.trim("text"), "[0-9]+", "#").alias("shape"), "doc_id").distinct()
    return shapes.groupBy("shape").agg(F.count("*").alias("pages")).where("pages >= 3")


@query(f"""
WITH {SQL_SECTIONS}, h AS (SELECT doc_id, ordinal, CASE WHEN length(text) < 40 THEN text END AS heading FROM sections)
SELECT doc_id, ordinal, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS part FROM h
""")
def heading_forward_fill(t) -> DataFrame:
    """The structured part each section belongs to: the last heading before it."""
    h = sections(t.documents).withColumn("heading", F.when(F.length("text") < 40, F.col("text")))
    return h.select("doc_id", "ordinal", F.last("heading", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0)).alias("part"))


@query(f"""
WITH {SQL_SECTIONS}, n AS (SELECT doc_id, ordinal, try_cast(regexp_extract(text, '([0-9]{{1,4}})', 1) AS INT) AS no FROM sections), p AS (SELECT *, lag(no) OVER (PARTITION BY doc_id ORDER BY ordinal) AS before FROM n WHERE no IS NOT NULL)
SELECT doc_id, ordinal, no, coalesce(no - before BETWEEN 1 AND 20, false) AS continues FROM p
""")
def numbering_continuation(t) -> DataFrame:
    """Whether a number continues the one before it with a gap of at most 20."""
    n = sections(t.documents).withColumn("no", F.expr("try_cast(regexp_extract(text, '([0-9]{1,4})', 1) AS INT)")).where("no IS NOT NULL")
    gap = F.col("no") - F.lag("no").over(_order())
    return n.select("doc_id", "ordinal", "no", F.coalesce(gap.between(1, 20), F.lit(False)).alias("continues"))


@query(f"""
WITH {SQL_SECTIONS}, x AS (SELECT doc_id, ordinal, unnest(regexp_extract_all(text, '[0-9]{{1,3}}(?:\\.[0-9]{{1,3}})+')) AS clause FROM sections) SELECT clause, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM x GROUP BY clause
""")
def clause_openings(t) -> DataFrame:
    """Dotted clause numbers stated in the sections."""
    x = sections(t.documents).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{1,3}(?:\\.[0-9]{1,3})+"), F.lit(0))).alias("clause"))
    return x.groupBy("clause").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.;!?]*[.;!?]')) AS sentence FROM documents)
SELECT doc_id, count(*)::BIGINT AS sentences, max(length(sentence))::BIGINT AS longest, count(CASE WHEN regexp_matches(lower(sentence), '(token|the)') THEN 1 END)::BIGINT AS marked FROM s GROUP BY doc_id
""")
def sentence_split(t) -> DataFrame:
    s = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^.;!?]*[.;!?]"), F.lit(0))).alias("sentence"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("sentence")).cast("bigint").alias("longest"), F.count_if(F.lower("sentence").rlike("(token|the)")).alias("marked"))


@query("""
SELECT doc_id, length(text) - length(regexp_replace(text, '[\\x{00AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]', '', 'g')) AS removed, regexp_matches(text, '[\\p{L}\\p{N}\\p{P}\\p{S}]') AS drawn FROM documents
""")
def invisible_characters(t) -> DataFrame:
    """How many format characters a text loses, and whether anything in it is drawn."""
    hidden = "[\\x{00AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]"
    return t.documents.select("doc_id", (F.length("text") - F.length(F.regexp_replace("text", hidden, ""))).cast("bigint").alias("removed"), F.col("text").rlike("[\\p{L}\\p{N}\\p{P}\\p{S}]").alias("drawn"))


@query(f"""
WITH {SQL_SECTIONS}, p AS (SELECT doc_id, ordinal, CASE WHEN trim(text) LIKE '%|%' THEN 'table' WHEN length(text) < 40 THEN 'heading' ELSE 'text' END AS kind FROM sections)
SELECT doc_id, kind AS status, count(*)::BIGINT AS n FROM p GROUP BY 1, 2
""")
def coverage_report(t) -> DataFrame:
    """What each document's parts were read as."""
    kind = F.when(F.trim("text").contains("|"), "table").when(F.length("text") < 40, "heading").otherwise("text")
    return sections(t.documents).groupBy("doc_id", kind.alias("status")).agg(F.count("*").alias("n"))


@query(f"""
WITH {SQL_SECTIONS}, l AS (SELECT doc_id, ordinal, length(text) AS n, lag(length(text)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS before FROM sections),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR n <= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT doc_id, min(ordinal)::INT AS first_ordinal, count(*)::BIGINT AS n FROM g GROUP BY doc_id, run HAVING count(*) >= 3
""")
def rising_runs(t) -> DataFrame:
    """Runs of at least three lines with rising numbers: gaps and islands by sequence."""
    lines = sections(t.documents).withColumn("n", F.length("text"))
    breaks = F.when(F.lag("n").over(_order()).isNull() | (F.col("n") <= F.lag("n").over(_order())), 1).otherwise(0)
    runs = lines.withColumn("b", breaks).withColumn("run", F.sum("b").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("n")).where("n >= 3").select("doc_id", "first_ordinal", "n")


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"]{2,40})"', 1)) AS term FROM documents) SELECT term, count(*)::BIGINT AS uses, min(doc_id) AS first_doc FROM w GROUP BY term
""")
def quoted_terms(t) -> DataFrame:
    """Quoted terms and the first document of each."""
    w = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('"([^"]{2,40})"'), F.lit(1))).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("uses"), F.min("doc_id").alias("first_doc"))


@query()
def built_sections(t) -> DataFrame:
    """Documents read as plain text and cut to numbered, size-capped sections."""
    return build_sections(read_documents(t.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))))
