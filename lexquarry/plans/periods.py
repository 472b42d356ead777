"""Periods read by the grammar in sentences put together from order lines; the statements know the numbers, not the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.periods import SMALL, TENS
from lexquarry.operators import period_reading

from .base import query

_WORDS = [*SMALL, *[t + (f"-{SMALL[k]}" if k else "") for t in TENS for k in range(10)]]
_SPELLED = "array(" + ", ".join(f"'{w}'" for w in _WORDS) + ")"
_LINES = "SELECT l_orderkey, l_linenumber, min(CAST(l_quantity AS INT)) AS a, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber"
#: How many ways a line's sentence is written.
WAYS = 16


def _sentences(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("int")).alias("a"), F.min("l_partkey").alias("p"))
    rows = rows.withColumn("b", F.col("a") + F.col("l_linenumber")).withColumn("way", (F.col("l_orderkey") + F.col("l_linenumber")) % WAYS)
    spelled = lambda c: f"element_at({_SPELLED}, CAST({c} AS INT) + 1)"
    text = f"""CASE way
      WHEN 0 THEN concat('Notice of ', a, ' days is given.')
      WHEN 1 THEN concat('Either party gives between ', a, ' and ', b, ' days’ notice.')
      WHEN 2 THEN concat('Upon ', {spelled('a')}, ' (', a, ') business days after delivery.')
      WHEN 3 THEN concat('Rent is due in ', {spelled('a')}, ' (', b, ') weeks.')
      WHEN 4 THEN concat('Terms of ', a, ', ', b, ' or ', b + 1, ' months are offered.')
      WHEN 5 THEN concat('Not less than ', a, ' nor more than ', b, ' weeks apply.')
      WHEN 6 THEN concat('Under Section ', a, ' and ', b, ' days it ends; see clause ', a, '.')
      WHEN 7 THEN concat('A fee of ', a, ' percent and ', b, ' years of care.')
      WHEN 8 THEN concat('Several days pass, and ', {spelled('b')}, ' working days are spent.')
      WHEN 9 THEN concat('Notice is given no later than ', a, ' days before the anniversary.')
      WHEN 10 THEN concat('It lasts a fortnight or ', a, ' calendar days.')
      WHEN 11 THEN concat('The buyer is not required to give ', {spelled('a')}, ' days of notice.')
      WHEN 12 THEN concat('Within ', {spelled('a')}, ' to ', {spelled('b')}, ' months.')
      WHEN 13 THEN concat('It runs 1', '‎', '0', a, ' days or more.')
      WHEN 14 THEN concat('One hundred and ', {spelled('a')}, ' days, at the most.')
      ELSE 'No period is agreed, a day or so apart from the rest of the year.' END"""
    return rows.withColumn("text", F.expr(text))


_SQL_MENTIONS = f"""
WITH s AS (SELECT *, a + l_linenumber AS b, (l_orderkey + l_linenumber) % {WAYS} AS way FROM ({_LINES}) x),
m(way, place, one, two, unit, range_end, operator, denied, back) AS (VALUES
  (0, 1, 'a', '', 'day', NULL, NULL, NULL, FALSE), (1, 1, 'a', '', 'day', 'low', NULL, NULL, FALSE), (1, 2, 'b', '', 'day', 'high', NULL, NULL, FALSE),
  (2, 1, 'a', '', 'business_day', NULL, NULL, NULL, FALSE), (3, 1, 'b', 'a', 'week', NULL, NULL, NULL, FALSE),
  (4, 1, 'a', '', 'month', NULL, NULL, NULL, FALSE), (4, 2, 'b', '', 'month', NULL, NULL, NULL, FALSE), (4, 3, 'b1', '', 'month', NULL, NULL, NULL, FALSE),
  (5, 1, 'a', '', 'week', NULL, 'min', NULL, FALSE), (5, 2, 'b', '', 'week', NULL, 'max', NULL, FALSE), (6, 1, 'b', '', 'day', NULL, NULL, NULL, FALSE),
  (7, 1, 'b', '', 'year', NULL, NULL, NULL, FALSE), (8, 1, 'b', '', 'business_day', NULL, NULL, NULL, FALSE), (9, 1, 'a', '', 'day', NULL, 'min', NULL, TRUE),
  (10, 1, '2', '', 'week', NULL, NULL, NULL, FALSE), (10, 2, 'a', '', 'day', NULL, NULL, NULL, FALSE), (11, 1, 'a', '', 'day', NULL, NULL, 'not', FALSE),
  (12, 1, 'a', '', 'month', 'low', 'max', NULL, FALSE), (12, 2, 'b', '', 'month', 'high', NULL, NULL, FALSE), (13, 1, '10a', '', 'day', NULL, 'min', NULL, FALSE),
  (14, 1, '100a', '', 'day', NULL, 'max', NULL, FALSE), (15, 1, '1', '', 'day', NULL, NULL, 'no', FALSE)),
n AS (SELECT *, CASE one WHEN 'a' THEN a::VARCHAR WHEN 'b' THEN b::VARCHAR WHEN 'b1' THEN (b + 1)::VARCHAR WHEN '10a' THEN '10' || a WHEN '100a' THEN (100 + a)::VARCHAR ELSE one END AS first_,
  CASE two WHEN 'a' THEN a::VARCHAR ELSE '' END AS second_ FROM s JOIN m USING (way))
SELECT l_orderkey, l_linenumber, place::INT AS place, first_ || CASE WHEN second_ <> '' THEN ' or ' || second_ ELSE '' END AS readings, unit, range_end, operator, denied, back FROM n
"""


@query(_SQL_MENTIONS)
def period_mentions(t) -> DataFrame:
    """Every period of every line's sentence: its readings, unit, range end, comparison, denial, and whether it is counted back."""
    found = period_reading.read_mentions(_sentences(t.lineitem), ["l_orderkey", "l_linenumber"], "text")
    rows = found.select("l_orderkey", "l_linenumber", F.posexplode("mentions").alias("pos", "m"))
    readings = F.array_join(F.transform("m.readings", lambda v: v.cast("bigint").cast("string")), " or ")
    return rows.select("l_orderkey", "l_linenumber", (F.col("pos") + 1).alias("place"), readings.alias("readings"), "m.unit", F.col("m.end").alias("range_end"), "m.operator", "m.denied", "m.back")


#: Guidance by nation: two sentences, of which the topic chooses one; x and y are the numbers of its rules.
_GUIDANCE = """CASE n_nationkey % 6
  WHEN 0 THEN concat('Payment terms are ', x, ' days. Termination needs at least ', y, ' days’ notice.')
  WHEN 1 THEN concat('Termination takes between ', x, ' and ', y + x, ' weeks of notice. Payment within ', y, ' days.')
  WHEN 2 THEN concat('Notice of termination must not be at least ', y, ' days. Payment terms are ', x, ' days.')
  WHEN 3 THEN concat('Termination notice is ', x, ' business days or more. Reports follow in ', y, ' months.')
  WHEN 4 THEN concat('Termination notice is no more than ', x, ' months. Payment terms are ', y, ' days.')
  ELSE 'Notice of termination is in writing.' END"""
_CONTRACT = """CASE l_linenumber % 6
  WHEN 0 THEN concat('Either party may terminate on ', a, ' days’ notice.')
  WHEN 1 THEN concat('The agreement ends after notice of ', a, ' weeks.')
  WHEN 2 THEN concat('Termination takes effect ', a, ' months after notice.')
  WHEN 3 THEN concat('Neither party is obliged to give ', a, ' days’ notice.')
  WHEN 4 THEN concat('It may be terminated upon ', a, ' business days’ notice.')
  ELSE 'The supplier may terminate immediately.' END"""
_SQL_VERDICTS = f"""
WITH c AS (SELECT l_orderkey, l_linenumber, a, l_linenumber % 6 AS way, n_nationkey, n_nationkey % 6 AS rule, 5 + n_nationkey AS x, 60 + 2 * n_nationkey AS y
  FROM ({_LINES}) l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
days AS (SELECT unnest(generate_series(DATE '2072-01-01', DATE '2127-12-31', INTERVAL 1 DAY))::DATE AS d),
months AS (SELECT m, min((d + to_months(m::INT))::DATE - d) AS lo, max((d + to_months(m::INT))::DATE - d) AS hi FROM days, range(1, 60) r(m) GROUP BY m),
seen AS (SELECT c.*, CASE way WHEN 0 THEN a WHEN 1 THEN 7 * a WHEN 2 THEN ml.lo WHEN 4 THEN a + 2 * ((a - 1) // 5) ELSE 0 END AS lo, CASE way WHEN 0 THEN a WHEN 1 THEN 7 * a WHEN 2 THEN ml.hi WHEN 4 THEN NULL ELSE 0 END AS hi,
  CASE rule WHEN 0 THEN y WHEN 1 THEN 7 * x WHEN 3 THEN x + 2 * ((x - 1) // 5) END AS floor_lo, CASE rule WHEN 0 THEN y WHEN 1 THEN 7 * x END AS floor_hi,
  CASE rule WHEN 1 THEN 7 * (y + x) WHEN 4 THEN mx.lo END AS cap_lo, CASE rule WHEN 1 THEN 7 * (y + x) WHEN 4 THEN mx.hi END AS cap_hi,
  way = 4 AND rule = 3 AS same_days, way = 2 AND rule = 4 AS same_months FROM c LEFT JOIN months ml ON ml.m = a LEFT JOIN months mx ON mx.m = x),
held AS (SELECT *, CASE WHEN rule NOT IN (0, 1, 3) THEN 1 WHEN same_days THEN (a >= x)::INT WHEN lo >= floor_hi THEN 1 WHEN hi < floor_lo THEN 0 ELSE 2 END AS floor_,
  CASE WHEN rule NOT IN (1, 4) THEN 1 WHEN same_months THEN (a <= x)::INT WHEN hi <= cap_lo THEN 1 WHEN lo > cap_hi THEN 0 ELSE 2 END AS cap FROM seen)
SELECT l_orderkey, l_linenumber, n_nationkey,
  CASE WHEN rule IN (2, 5) THEN 'incomparable' WHEN way = 3 THEN 'needs_review' WHEN floor_ = 0 OR cap = 0 THEN 'needs_review' WHEN floor_ = 2 OR cap = 2 THEN 'incomparable' ELSE 'pass' END AS outcome,
  CASE WHEN rule = 2 THEN 'rule not read' WHEN rule = 5 THEN 'no rule' WHEN way = 3 THEN 'denied: neither' WHEN floor_ = 0 OR cap = 0 THEN 'outside' WHEN floor_ = 2 OR cap = 2 THEN 'calendars differ' ELSE 'inside' END AS reason
FROM held
"""


@query(_SQL_VERDICTS)
def guidance_verdicts(t) -> DataFrame:
    """Each line's termination sentence against the guidance of its customer's nation: the sentence about the topic gives the rule."""
    rules = t.nation.withColumn("x", F.col("n_nationkey") + 5).withColumn("y", 2 * F.col("n_nationkey") + 60).select("n_nationkey", F.expr(_GUIDANCE).alias("guidance"))
    lines = _sentences(t.lineitem).select("l_orderkey", "l_linenumber", F.expr(_CONTRACT).alias("text"))
    rows = lines.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(rules, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select("l_orderkey", "l_linenumber", "n_nationkey", "text", "guidance", F.lit("termination notice").alias("topic"), F.lit(5).alias("week"))
    return period_reading.judge(rows, ["l_orderkey", "l_linenumber", "n_nationkey"], "text", "guidance", "topic", "week")


_DEFINED = """CASE p % 9
  WHEN 0 THEN '“Business Day” means a day other than a Saturday, Sunday or public holiday.'
  WHEN 1 THEN 'A Business Day is Monday to Friday. Fees are due.'
  WHEN 2 THEN 'Working Days are all days excluding Sundays; goods are sent.'
  WHEN 3 THEN '“Business Day” means any day on which banks are open.'
  WHEN 4 THEN 'Business Days means Tuesday, Thursday and Friday.'
  WHEN 5 THEN 'Business Day means any day, including a Saturday.'
  WHEN 6 THEN '“Working Day” means any day except weekends.'
  ELSE 'Goods are delivered on a business day.' END"""
_SQL_WEEKS = f"""
SELECT l_orderkey, CASE WHEN count(*) = count(w) AND min(w) = max(w) THEN min(w)::INT END AS week
FROM (SELECT l_orderkey, p, CASE p % 9 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 4 THEN 3 WHEN 6 THEN 5 END AS w FROM ({_LINES}) l) x WHERE p % 9 < 7 GROUP BY l_orderkey
"""


@query(_SQL_WEEKS)
def business_weeks(t) -> DataFrame:
    """The business week that the definitions of an order's lines agree on; null where one does not say or two differ."""
    rows = _sentences(t.lineitem).select("l_orderkey", F.expr(_DEFINED).alias("text"))
    return period_reading.agreed_week(period_reading.definition_weeks(rows, ["l_orderkey"], "text"), ["l_orderkey"])
