"""Typed values: periods, dates, stated numbers, and how an answer's values stand to its quotes'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.periods import compare, month_spans, read_periods, same_period

from .base import query

_RULES = [
    (1, 30.0, "day", "min", 30.0, "day"),
    (2, 4.0, "week", "min", 30.0, "day"),
    (3, 1.0, "month", "min", 30.0, "day"),
    (4, 2.0, "month", "max", 60.0, "day"),
    (5, 3.0, "month", "min", 89.0, "day"),
    (6, 10.0, "day", "max", 2.0, "week"),
    (7, 14.0, "day", "exact", 2.0, "week"),
    (8, 1.0, "month", "max", 31.0, "day"),
    (9, 6.0, "month", "min", 2.0, "month"),
]
_VALUES = ", ".join(str(r).replace("'", "'") for r in _RULES)


@query("""
WITH d AS (SELECT unnest(generate_series(DATE '2072-01-01', DATE '2127-12-31', INTERVAL 1 DAY))::DATE AS d), s AS (SELECT m AS months, date_diff('day', d, (d + to_months(m::INT))::DATE) AS n FROM d CROSS JOIN range(1, 37) r(m))
SELECT months::INT AS months, min(n)::INT AS lo, max(n)::INT AS hi FROM s GROUP BY months
""")
def calendar_span_table(t) -> DataFrame:
    """Days that 1 to 36 months can have, over every start date of 56 years."""
    return month_spans(t.spark, 36)


@query(f"""
WITH r(id, ov, ou, op, bv, bu) AS (VALUES {_VALUES}), d AS (SELECT unnest(generate_series(DATE '2072-01-01', DATE '2127-12-31', INTERVAL 1 DAY))::DATE AS d),
s AS (SELECT m AS months, min(date_diff('day', d, (d + to_months(m::INT))::DATE)) AS lo, max(date_diff('day', d, (d + to_months(m::INT))::DATE)) AS hi FROM d CROSS JOIN range(1, 13) x(m) GROUP BY m),
i AS (SELECT r.*, CASE ou WHEN 'day' THEN ov WHEN 'week' THEN 7 * ov ELSE a.lo END AS alo, CASE ou WHEN 'day' THEN ov WHEN 'week' THEN 7 * ov ELSE a.hi END AS ahi,
 CASE bu WHEN 'day' THEN bv WHEN 'week' THEN 7 * bv ELSE b.lo END AS blo, CASE bu WHEN 'day' THEN bv WHEN 'week' THEN 7 * bv ELSE b.hi END AS bhi FROM r LEFT JOIN s a ON a.months = ov LEFT JOIN s b ON b.months = bv)
SELECT id, CASE op WHEN 'min' THEN CASE WHEN alo >= bhi THEN 'pass' WHEN ahi < blo THEN 'needs_review' ELSE 'incomparable' END
WHEN 'max' THEN CASE WHEN ahi <= blo THEN 'pass' WHEN alo > bhi THEN 'needs_review' ELSE 'incomparable' END
ELSE CASE WHEN alo = ahi AND blo = bhi AND alo = blo THEN 'pass' WHEN ahi < blo OR alo > bhi THEN 'needs_review' ELSE 'incomparable' END END AS verdict,
(ou = bu AND ov = bv) OR coalesce(CASE ou WHEN 'day' THEN ov WHEN 'week' THEN 7 * ov END = CASE bu WHEN 'day' THEN bv WHEN 'week' THEN 7 * bv END, false) AS same FROM i
""")
def period_compare(t) -> DataFrame:
    """Observed periods against bounds, on every calendar."""
    r = t.spark.createDataFrame(_RULES, "id int, ov double, ou string, op string, bv double, bu string")
    spans = month_spans(t.spark, 12)
    a = spans.select(F.col("months").cast("double").alias("ov"), F.col("lo").alias("mlo"), F.col("hi").alias("mhi"))
    b = spans.select(F.col("months").cast("double").alias("bv"), F.col("lo").alias("nlo"), F.col("hi").alias("nhi"))
    i = r.join(a, "ov", "left").join(b, "bv", "left")
    edge = lambda v, u, m: F.when(F.col(u) == "day", F.col(v)).when(F.col(u) == "week", F.col(v) * 7).otherwise(F.col(m))
    verdict = compare(F.col("op"), edge("ov", "ou", "mlo"), edge("ov", "ou", "mhi"), edge("bv", "bu", "nlo"), edge("bv", "bu", "nhi"))
    return i.select("id", verdict.alias("verdict"), same_period(F.col("ov"), F.col("ou"), F.col("bv"), F.col("bu")).alias("same"))


@query()
def stated_periods(t) -> DataFrame:
    """Periods in every turn of the conversations and in a few worked sentences."""
    extra = t.spark.createDataFrame(
        [
            (-1, "at least thirty (30) days' notice"),
            (-2, "not more than ten (12) business days"),
            (-3, "one hundred and twenty days or 6 months"),
            (-4, "3 to 5 years, renewed weekly"),
            (-5, None),
            (-6, "within 1,500 hours"),
        ],
        "id bigint, text string",
    )
    rows = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text").unionByName(extra)
    found = read_periods(rows, "id", "text").select("id", F.posexplode("periods").alias("n", "p"))
    return found.select("id", "n", "p.start", "p.stop", "p.unit", F.col("p.readings")[0].alias("value"), "p.upper", "p.operator", "p.ambiguous")


@query("""
SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE a.l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linestatus = 'F' AND b.l_quantity = a.l_quantity)
""")
def value_antijoin(t) -> DataFrame:
    """Values of an answer that no quote of its run states."""
    answer = t.lineitem.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "l_quantity")
    quoted = t.lineitem.where("l_linestatus = 'F'").select("l_orderkey", "l_quantity")
    return answer.join(quoted, ["l_orderkey", "l_quantity"], "left_anti").select("l_orderkey", "l_linenumber")


@query("""
WITH g AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS offered, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_suppkey END) AS used FROM lineitem GROUP BY 1)
SELECT l_orderkey, offered::BIGINT AS offered, used::BIGINT AS used FROM g WHERE offered >= 2 AND used BETWEEN 1 AND offered - 1
""")
def value_choices(t) -> DataFrame:
    """Groups that offer several values of which the answer uses some, not all."""
    used = F.countDistinct(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey")))
    g = t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("offered"), used.alias("used"))
    return g.where("offered >= 2 AND used BETWEEN 1 AND offered - 1")


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda x: x[1:5])) AS stems FROM conversations)
SELECT a.conv_id, a.turn, len(list_intersect(a.stems, b.stems))::INT AS shared, len(list_intersect(a.stems, b.stems)) >= least(2, len(a.stems)) AS same_point FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
""")
def same_point(t) -> DataFrame:
    """Whether a turn is about what the one before it was: shared five-letter stems."""
    stems = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), lambda x: F.substring(x, 1, 5)))
    w = t.conversations.select("conv_id", "turn", stems.alias("stems"))
    both = w.join(w.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("stems").alias("before")), ["conv_id", "turn"])
    shared = F.size(F.array_intersect("stems", "before"))
    return both.select("conv_id", "turn", shared.alias("shared"), (shared >= F.least(F.lit(2), F.size("stems"))).alias("same_point"))


@query(r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}\b')) AS raw FROM documents), p AS (SELECT doc_id, raw, string_split_regex(raw, '[./-]') AS x FROM d)
SELECT doc_id, raw, CASE WHEN x[1]::INT > 12 AND x[2]::INT <= 12 THEN x[3] || '-' || lpad(x[2], 2, '0') || '-' || lpad(x[1], 2, '0') WHEN x[2]::INT > 12 AND x[1]::INT <= 12 THEN x[3] || '-' || lpad(x[1], 2, '0') || '-' || lpad(x[2], 2, '0') END AS iso FROM p
""")
def numeric_dates(t) -> DataFrame:
    """Dates in figures, read where the day is above 12, else set aside."""
    d = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}\b"), F.lit(0))).alias("raw"))
    x = d.withColumn("x", F.split("raw", "[./-]"))
    a, b = F.col("x")[0].cast("int"), F.col("x")[1].cast("int")
    two = lambda k: F.lpad(F.col("x")[k], 2, "0")
    iso = F.when((a > 12) & (b <= 12), F.concat_ws("-", F.col("x")[2], two(1), two(0))).when((b > 12) & (a <= 12), F.concat_ws("-", F.col("x")[2], two(0), two(1)))
    return x.select("doc_id", "raw", iso.alias("iso"))


@query(r"""
WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{3,}\b')) AS n FROM documents) SELECT doc_id, count(*)::BIGINT AS stated, count(DISTINCT n)::BIGINT AS different FROM v GROUP BY doc_id
""")
def stated_numbers(t) -> DataFrame:
    v = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{3,}\b"), F.lit(0))).alias("n"))
    return v.groupBy("doc_id").agg(F.count("*").alias("stated"), F.countDistinct("n").alias("different"))


@query("""
SELECT a.l_orderkey, a.l_linenumber, count(*)::BIGINT AS bearing FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber <> a.l_linenumber
AND (b.l_suppkey = a.l_suppkey OR abs(b.l_quantity - a.l_quantity) <= 5) WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R' GROUP BY 1, 2
""")
def settle_together(t) -> DataFrame:
    """A pass beside a related shortfall of the same run."""
    a = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    b = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("bn"), F.col("l_suppkey").alias("bs"), F.col("l_quantity").alias("bq"))
    return a.join(b, "l_orderkey").where("bn <> l_linenumber AND (bs = l_suppkey OR abs(bq - l_quantity) <= 5)").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("bearing"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IS NULL THEN 'unsupported' WHEN l_discount > 0.08 THEN 'ambiguous_fact' WHEN l_returnflag = 'R' AND l_tax > 0.05 THEN 'needs_review' WHEN l_returnflag = 'R' THEN 'model_review'
WHEN l_linestatus = 'F' THEN 'pass' ELSE 'not_found' END AS status, CASE WHEN l_quantity IS NULL OR l_discount > 0.08 OR (l_returnflag = 'R' AND l_tax > 0.05) THEN 'code' ELSE 'model_hint' END AS source FROM lineitem
""")
def status_decision(t) -> DataFrame:
    """One ordered rule list; a pass is never the code's own."""
    rules = [
        (F.col("l_quantity").isNull(), "unsupported", "code"),
        (F.col("l_discount") > 0.08, "ambiguous_fact", "code"),
        ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05), "needs_review", "code"),
        (F.col("l_returnflag") == "R", "model_review", "model_hint"),
        (F.col("l_linestatus") == "F", "pass", "model_hint"),
    ]
    status, source = F, F
    for when, s, who in rules:
        status, source = status.when(when, s), source.when(when, who)
    return t.lineitem.select("l_orderkey", "l_linenumber", status.otherwise("not_found").alias("status"), source.otherwise("model_hint").alias("source"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, (l_partkey % 1000)::BIGINT AS start, (l_partkey % 1000 + l_quantity)::BIGINT AS stop FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, count(*)::BIGINT AS overlaps, count(CASE WHEN b.start <= a.start AND b.stop >= a.stop THEN 1 END)::BIGINT AS inside
FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND b.start < a.stop AND b.stop > a.start GROUP BY 1, 2
""")
def span_overlap_interval_join(t) -> DataFrame:
    """Spans of one run that overlap, and those that contain another."""
    start = (F.col("l_partkey") % 1000).cast("bigint")
    s = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), start.alias("start"), (F.col("l_partkey") % 1000 + F.col("l_quantity")).cast("bigint").alias("stop"))
    b = s.select("l_orderkey", F.col("n").alias("bn"), F.col("start").alias("bs"), F.col("stop").alias("be"))
    both = s.join(b, "l_orderkey").where("n <> bn AND bs < stop AND be > start")
    return both.groupBy("l_orderkey", F.col("n").alias("l_linenumber")).agg(F.count("*").alias("overlaps"), F.count_if((F.col("bs") <= F.col("start")) & (F.col("be") >= F.col("stop"))).alias("inside"))


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS k, p_partkey // 2 AS up FROM part WHERE p_partkey > 1), r AS (SELECT k, up, 1 AS depth FROM e UNION ALL SELECT r.k, e.up, depth + 1 FROM r JOIN e ON e.k = r.up)
SELECT k, count(*)::BIGINT AS ancestors, max(depth)::INT AS depth FROM r GROUP BY k
""")
def lineage_ancestors(t) -> DataFrame:
    """How many earlier versions each version has, by pointer doubling: rounds follow the logarithm of the longest line."""
    from lexquarry.operators.lineage import depths

    edges = t.part.where("p_partkey > 1").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 2").alias("up"))
    return depths(edges).select("k", F.col("depth").cast("bigint").alias("ancestors"), F.col("depth").cast("int").alias("depth"))
