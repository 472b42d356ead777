"""Layout geometry: merging and subtracting intervals, columns, bands and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.session import dealt

from .base import query

_SQL_SPANS = "s AS (SELECT l_orderkey AS page, (l_partkey % 100)::DOUBLE AS lo, (l_partkey % 100 + l_quantity / 10)::DOUBLE AS hi, l_linenumber AS n, l_suppkey AS k FROM lineitem)"
_SQL_MERGED = f"""{_SQL_SPANS}, o AS (SELECT *, max(hi) OVER (PARTITION BY page ORDER BY lo, hi, n, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY lo, hi, n, k ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT page, island, min(lo) AS lo, max(hi) AS hi, count(*) AS parts FROM g GROUP BY 1, 2)"""


def spans(t) -> DataFrame:
    """Horizontal extents of the lines of each page."""
    lo = (F.col("l_partkey") % 100).cast("double")
    return dealt(t.lineitem.select(F.col("l_orderkey").alias("page"), lo.alias("lo"), (lo + F.col("l_quantity") / 10).alias("hi")), "page")


def merged(rows: DataFrame) -> DataFrame:
    """Islands of intervals that touch within 0.1."""
    order = Window.partitionBy("page").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("fresh", F.when(before.isNull() | (F.col("lo") > before + 0.1), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("page", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("parts"))


@query(f"WITH {_SQL_MERGED} SELECT page, lo, hi, parts::BIGINT AS parts FROM m")
def interval_merge(t) -> DataFrame:
    return merged(spans(t)).select("page", "lo", "hi", "parts")


@query(f"""
WITH {_SQL_MERGED}, e AS (SELECT page, coalesce(lag(hi) OVER (PARTITION BY page ORDER BY lo), 0) AS lo, lo AS hi FROM m UNION ALL SELECT page, max(hi), 110 FROM m GROUP BY page) SELECT page, lo, hi FROM e WHERE hi > lo
""")
def interval_complement(t) -> DataFrame:
    """What the intervals of a page leave free of [0, 110]."""
    m = merged(spans(t))
    gaps = m.select("page", F.coalesce(F.lag("hi").over(Window.partitionBy("page").orderBy("lo")), F.lit(0.0)).alias("lo"), F.col("lo").alias("hi"))
    return gaps.unionByName(m.groupBy("page").agg(F.max("hi").alias("lo")).select("page", "lo", F.lit(110.0).alias("hi"))).where("hi > lo")


@query(f"""
WITH {_SQL_MERGED}, x AS (SELECT a.page, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM m a JOIN m b ON b.page = a.page + 1) SELECT page, count(*)::BIGINT AS shared, round(sum(hi - lo), 6) AS width FROM x WHERE hi > lo GROUP BY page
""")
def interval_intersection(t) -> DataFrame:
    """What a page's extents have in common with the next page's."""
    m = merged(spans(t)).select("page", "lo", "hi")
    both = m.join(m.select((F.col("page") - 1).alias("page"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "page")
    width = F.least("hi", "hi2") - F.greatest("lo", "lo2")
    return both.where(width > 0).groupBy("page").agg(F.count("*").alias("shared"), F.round(F.sum(width), 6).alias("width"))


@query(f"""
WITH {_SQL_MERGED}, gut AS (SELECT page, hi AS at FROM m WHERE parts >= 2) SELECT s.page, s.n AS line, s.k, (SELECT count(*) FROM gut WHERE gut.page = s.page AND gut.at <= (s.lo + s.hi) / 2)::BIGINT AS col FROM s
""")
def column_of(t) -> DataFrame:
    """The column of each line: how many gutters lie left of its midpoint."""
    gutters = merged(spans(t)).where("parts >= 2").groupBy("page").agg(F.collect_list("hi").alias("at"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 100).cast("double").alias("lo"), "l_quantity")
    mid = (F.col("lo") + F.col("lo") + F.col("l_quantity") / 10) / 2
    joined = rows.withColumn("mid", mid).join(gutters, "page", "left")
    return joined.select("page", "line", "k", F.coalesce(F.size(F.filter("at", lambda x: x <= F.col("mid"))), F.lit(0)).cast("bigint").alias("col")).withColumn("col", F.greatest("col", F.lit(0)))


@query("""
SELECT l_orderkey AS page, count(*)::BIGINT AS glyphs, count(CASE WHEN l_tax < 0.02 THEN 1 WHEN l_discount > 0.09 THEN 1 WHEN l_partkey % 100 BETWEEN 20 AND 30 AND l_quantity BETWEEN 10 AND 20 THEN 1 END)::BIGINT AS hidden, median(l_quantity) AS height
FROM lineitem GROUP BY 1
""")
def hidden_glyphs(t) -> DataFrame:
    """Glyphs that are not drawn: tiny, invisible, or inside a painted box; with the exact median height."""
    hidden = (F.col("l_tax") < 0.02) | (F.col("l_discount") > 0.09) | ((F.col("l_partkey") % 100).between(20, 30) & F.col("l_quantity").between(10, 20))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("page")).agg(F.count("*").alias("glyphs"), F.count_if(hidden).alias("hidden"), F.median("l_quantity").alias("height"))


@query("""
WITH d AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS step FROM events), r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth FROM d)
SELECT user_id, min(depth)::BIGINT AS lowest, max_by(depth, (ts, event_id))::BIGINT AS final, min(depth) >= 0 AND max_by(depth, (ts, event_id)) = 0 AS balanced FROM r GROUP BY user_id
""")
def fields_balance(t) -> DataFrame:
    """Whether opened fields are all closed, and never before they open: a running depth."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    r = t.events.withColumn("step", step).withColumn("depth", F.sum("step").over(w))
    final = F.max_by("depth", F.struct("ts", "event_id"))
    return r.groupBy("user_id").agg(F.min("depth").alias("lowest"), final.alias("final"), ((F.min("depth") >= 0) & (final == 0)).alias("balanced"))
