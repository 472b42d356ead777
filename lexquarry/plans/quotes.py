"""Quotes: where a passage stands, how often, in which section; the typed ladder runs in lexquarry.operators.spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.text import SQL_SECTIONS, length_prefixed, plain_words, sections, shingles
from lexquarry.operators.spans import locate_quotes

from .base import query

KEY = 5


def holders(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, quote, doc_id, text) of the documents that hold a quote.

    A quote's first words are its key; documents give the word runs of that length, and the two meet in an equi-join, so
    no quote is searched in a document that does not hold its key. Quotes with fewer words are searched everywhere.
    """
    w = plain_words(F.col("quote"))
    keyed = quotes.select("item_id", "quote", F.size(w).alias("n"), F.concat_ws(" ", F.slice(w, 1, KEY)).alias("key")).where("quote <> ''")
    grams = documents.select("doc_id", plain_words(F.col("text")).alias("w")).select("doc_id", F.explode(shingles("w", KEY)).alias("key"))
    near = grams.join(keyed.where(f"n > {KEY}"), "key").select("item_id", "quote", "doc_id")
    found = documents.join(near, "doc_id").where(F.contains("text", "quote"))
    short = keyed.where(f"n <= {KEY}").select("item_id", "quote")
    rest = documents.join(short, F.contains("text", "quote"))
    return found.select("item_id", "quote", "doc_id", "text").unionByName(rest.select("item_id", "quote", "doc_id", "text"))


def _count(text: str, quote: str):
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(F.col(text), F.col(quote), F.lit("")))) / F.length(quote)).cast("bigint")


_SQL_PLACES = """SELECT item_id, doc_id, (instr(d.text, b.text) - 1)::BIGINT AS start, (instr(d.text, b.text) - 1 + length(b.text))::BIGINT AS stop,
((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::BIGINT AS places FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""


@query(_SQL_PLACES)
def quote_exact_places(t) -> DataFrame:
    """First place and number of places of each whole passage in each document, in code points."""
    found = holders(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("quote")))
    start = (F.instr("text", F.col("quote")) - 1).cast("bigint")
    return found.select("item_id", "doc_id", start.alias("start"), (start + F.length("quote")).alias("stop"), _count("text", "quote").alias("places"))


@query(f"SELECT item_id, sum(places)::BIGINT AS places, count(*)::BIGINT AS docs, sum(places) = 1 AS is_unique FROM ({_SQL_PLACES}) x GROUP BY item_id")
def quote_unique_flag(t) -> DataFrame:
    places = quote_exact_places(t)
    return places.groupBy("item_id").agg(F.sum("places").alias("places"), F.count("*").alias("docs"), (F.sum("places") == 1).alias("is_unique"))


@query(f"""
WITH {SQL_SECTIONS}, q AS (SELECT item_id, text AS quote FROM benchmark WHERE text <> ''), hit AS (SELECT item_id, doc_id, min(ordinal) AS ordinal, min(CASE WHEN ordinal = 0 THEN 0 END) AS cited
FROM q JOIN sections ON contains(sections.text, q.quote) GROUP BY 1, 2)
SELECT item_id, doc_id, coalesce(cited, ordinal)::INT AS ordinal, cited IS NULL AS relocated FROM hit
""")
def quote_relocated(t) -> DataFrame:
    """The cited section (the first) if it holds the quote, else the next candidate that does."""
    lines = sections(t.documents).withColumn("doc_id", F.struct("doc_id", "ordinal"))
    q = t.benchmark.select("item_id", F.col("text").alias("quote"))
    found = holders(lines.select("doc_id", "text"), q).select("item_id", "doc_id.doc_id", "doc_id.ordinal")
    return found.groupBy("item_id", "doc_id").agg(F.min("ordinal").alias("ordinal"), (F.min("ordinal") > 0).alias("relocated"))


@query(f"""
WITH {SQL_SECTIONS}, h AS (SELECT doc_id, ordinal, sha256(text) AS content FROM sections)
SELECT doc_id, ordinal, sha256('section/v1' || chr(31) || length(ordinal::VARCHAR) || ':' || ordinal || chr(31) || '64:' || content) AS key FROM h
""")
def section_key_fingerprint(t) -> DataFrame:
    """Content-addressed section keys: the label and the digest of the text, length-prefixed."""
    s = sections(t.documents)
    return s.select("doc_id", "ordinal", length_prefixed("section/v1", F.col("ordinal").cast("string"), F.sha2("text", 256)).alias("key"))


@query()
def quote_ladder(t) -> DataFrame:
    """Every passage, changed in case or in its blanks, located by the ladder in the documents that can hold it."""
    changed = F.when(F.col("item_id") % 2 == 0, F.upper("text")).otherwise(F.replace("text", F.lit(" "), F.lit("  ")))
    return locate_quotes(t.benchmark.select("item_id", changed.alias("quote")), t.documents.select("doc_id", "text"))


@query(f"""
WITH {SQL_SECTIONS}, s AS (SELECT doc_id, ordinal, sha256(text) AS content, text FROM sections), n AS (SELECT item_id, text AS quote FROM benchmark)
SELECT content AS key, count(*)::BIGINT AS holders, min(doc_id) AS first_doc FROM s GROUP BY content HAVING count(*) > 1
""")
def repeated_sections(t) -> DataFrame:
    """Sections that several documents hold word for word."""
    s = sections(t.documents).select("doc_id", F.sha2("text", 256).alias("key"))
    return s.groupBy("key").agg(F.count("*").alias("holders"), F.min("doc_id").alias("first_doc")).where("holders > 1")


#: Ways of reading a document's text, in expressions that both engines read.
ADAPTERS = (("as it is", "text"), ("one line", "replace(text, chr(10), ' ')"), ("no commas", "replace(text, ',', '')"))
_SQL_ADAPTED = " UNION ALL ".join(f"SELECT '{name}' AS adapter, item_id, doc_id FROM q JOIN documents d ON contains({x}, quote)" for name, x in ADAPTERS)


@query(f"""
WITH q AS (SELECT item_id, text AS quote FROM benchmark WHERE text <> ''), a AS ({_SQL_ADAPTED})
SELECT adapter, count(DISTINCT item_id)::BIGINT AS quotes, count(*)::BIGINT AS places FROM a GROUP BY adapter
""")
def parser_comparison(t) -> DataFrame:
    """How many quotes each reading of the documents retains word for word, and in how many documents."""
    q = t.benchmark.select("item_id", F.col("text").alias("quote"))
    found = [holders(t.documents.selectExpr("doc_id", f"{x} AS text"), q).select(F.lit(name).alias("adapter"), "item_id") for name, x in ADAPTERS]
    return reduce(DataFrame.unionByName, found).groupBy("adapter").agg(F.count_distinct("item_id").alias("quotes"), F.count("*").alias("places"))
