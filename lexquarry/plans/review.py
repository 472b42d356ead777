"""Reading and reviewing findings: answers, coverage of expert spans, concerns, windows, parts and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.text import SQL_SECTIONS, sections

from .base import query


@query("""
SELECT l_orderkey, min_by(l_suppkey, (l_linenumber, l_suppkey)) AS answer, min(l_linenumber)::INT AS place FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey
""")
def first_answer(t) -> DataFrame:
    """The first finding of each run that answers."""
    rows = t.lineitem.where("l_returnflag <> 'N'")
    return rows.groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("answer"), F.min("l_linenumber").cast("int").alias("place"))


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.t, b.t)) / greatest(1, len(list_distinct(list_concat(a.t, b.t)))), 4) AS jaccard,
round(len(list_intersect(a.t, b.t)) / greatest(1, len(a.t)), 4) AS coverage, len(list_intersect(a.t, b.t)) / greatest(1, len(list_distinct(list_concat(a.t, b.t)))) >= 0.5 AS hit
FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
""")
def span_hits(t) -> DataFrame:
    """Token Jaccard and coverage of a passage by the one before it; a hit from one half on."""
    w = t.conversations.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("t"))
    both = w.join(w.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("t").alias("b")), ["conv_id", "turn"])
    common, union = F.size(F.array_intersect("t", "b")), F.size(F.array_union("t", "b"))
    j = common / F.greatest(F.lit(1), union)
    return both.select("conv_id", "turn", F.round(j, 4).alias("jaccard"), F.round(common / F.greatest(F.lit(1), F.size("t")), 4).alias("coverage"), (j >= 0.5).alias("hit"))


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, array_to_string(list_filter([CASE WHEN l_discount > 0.08 THEN 'value' END, CASE WHEN l_tax > 0.06 THEN 'condition' END, CASE WHEN l_returnflag = 'R' THEN 'replaced' END,
CASE WHEN l_quantity < 3 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS concerns, l_discount > 0.08 OR l_tax > 0.06 OR l_returnflag = 'R' OR l_quantity < 3 AS flagged FROM lineitem
""")
def concerns(t) -> DataFrame:
    """What speaks against each finding, in a fixed order, and whether anything does."""
    rules = [(F.col("l_discount") > 0.08, "value"), (F.col("l_tax") > 0.06, "condition"), (F.col("l_returnflag") == "R", "replaced"), (F.col("l_quantity") < 3, "short")]
    listed = F.concat_ws(",", *[F.when(c, n) for c, n in rules])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", listed.alias("concerns"), (listed != "").alias("flagged"))


@query(f"""
WITH {SQL_SECTIONS} SELECT doc_id, ordinal, substr(text, 1, 60) AS slice, length(text) > 60 AS truncated, greatest(0, length(text) - 60)::BIGINT AS outside FROM sections
""")
def context_window(t) -> DataFrame:
    """What a window shows of each section, and how much it leaves out."""
    n = F.length("text")
    return sections(t.documents).select("doc_id", "ordinal", F.substring("text", 1, 60).alias("slice"), (n > 60).alias("truncated"), F.greatest(F.lit(0), n - 60).cast("bigint").alias("outside"))


@query(f"""
WITH {SQL_SECTIONS}, b AS (SELECT doc_id, ordinal, length(text) % 3 AS k, lag(length(text) % 3) OVER (PARTITION BY doc_id ORDER BY ordinal) AS before FROM sections),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> k THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT doc_id, min(ordinal)::INT AS first_ordinal, count(*)::BIGINT AS parts FROM g GROUP BY doc_id, run HAVING count(*) >= 2
""")
def reading_parts(t) -> DataFrame:
    """Runs of two or more consecutive parts under one label."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    k = sections(t.documents).withColumn("k", F.length("text") % 3)
    before = F.lag("k").over(w)
    runs = k.withColumn("fresh", F.when(before.isNull() | (before != F.col("k")), 1).otherwise(0)).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("parts")).where("parts >= 2").select("doc_id", "first_ordinal", "parts")


@query("""
WITH v AS (SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS n FROM part) SELECT p_partkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 12 THEN 'current' WHEN n < 12 THEN 'earlier' ELSE 'unknown' END AS version FROM v
""")
def recorded_version(t) -> DataFrame:
    """A recorded rule version against the current one: a later one is unknown here."""
    n = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return t.part.select("p_partkey", F.when(n == 12, "current").when(n < 12, "earlier").otherwise("unknown").alias("version"))


@query("""
WITH a AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, coalesce(a.n = p.n, false) AS aligned, CASE WHEN a.n = p.n THEN p.n ELSE 0 END::BIGINT AS pairs FROM p LEFT JOIN a ON a.l_orderkey = p.conv_id
""")
def proposal_alignment(t) -> DataFrame:
    """Proposals meet findings by place, or not at all where their numbers differ."""
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("conv_id")).agg(F.count("*").alias("a"))
    p = t.conversations.groupBy("conv_id").agg(F.count("*").alias("p")).join(a, "conv_id", "left")
    same = F.coalesce(F.col("a") == F.col("p"), F.lit(False))
    return p.select("conv_id", same.alias("aligned"), F.when(same, F.col("p")).otherwise(0).alias("pairs"))


@query("""
SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS input_hash, count(*)::BIGINT AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id
""")
def input_rebuild(t) -> DataFrame:
    """The ordered input of each run put together again, with its digest."""
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("m")))), lambda x: x["m"]))
    return t.conversations.groupBy("conv_id").agg(F.sha2(joined.cast("binary"), 256).alias("input_hash"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("""
WITH s AS (SELECT doc_id, lang, source, n_chars FROM documents) SELECT lang, count(*)::BIGINT AS docs, count(DISTINCT source)::BIGINT AS sources, sum(n_chars)::BIGINT AS chars, max(n_chars)::BIGINT AS longest FROM s GROUP BY lang
""")
def corpus_census(t) -> DataFrame:
    """Denominators of the corpus by language; the text is never read."""
    return t.documents.groupBy("lang").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("""
SELECT l_orderkey, count(CASE WHEN l_quantity > 25 THEN 1 END)::BIGINT AS prefix_bucket, count(*)::BIGINT - count(CASE WHEN l_quantity > 25 THEN 1 END)::BIGINT AS remainder FROM lineitem GROUP BY 1
""")
def method_families(t) -> DataFrame:
    """Buckets of methods and what is left over."""
    own = F.count_if(F.col("l_quantity") > 25)
    return t.lineitem.groupBy("l_orderkey").agg(own.alias("prefix_bucket"), (F.count("*") - own).alias("remainder"))


@query("""
SELECT user_id, event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND b.ts <= a.ts) AS opening FROM events a WHERE event_type = 'purchase'
""")
def clause_label_asof(t) -> DataFrame:
    """The label a place belongs to: the last opening at or before it, carried forward in order."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = t.events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return rows.withColumn("opening", F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w)).where("event_type = 'purchase'").select("user_id", "event_id", "opening")
