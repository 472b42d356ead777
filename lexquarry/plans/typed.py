"""Typed values in whole contracts put together from an order's lines; the statements know the values, not the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators import value_support

from .base import query

_ROWS = """SELECT l_orderkey, l_linenumber, min(CAST(l_quantity AS INT)) AS a, min(CAST(floor(l_extendedprice) AS BIGINT)) AS m, min(CAST(l_shipdate AS DATE)) AS d, min(CAST(round(l_discount * 100) AS INT)) AS pc
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def _lines(t) -> DataFrame:
    one = {"a": "CAST(l_quantity AS INT)", "m": "CAST(floor(l_extendedprice) AS BIGINT)", "d": "CAST(l_shipdate AS DATE)", "pc": "CAST(round(l_discount * 100) AS INT)"}
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.expr(f"min({x})").alias(k) for k, x in one.items()])


#: A line's clause, by its way of writing; what it states is in _FACTS.
_CLAUSE = """CASE (l_orderkey + l_linenumber) % 9
  WHEN 0 THEN concat('Section ', l_linenumber, '. The price of $', format_number(m, 0), ' falls due on ', date_format(d, 'yyyy-MM-dd'), '.')
  WHEN 1 THEN concat('A rebate of ', pc, '% is given for ', a, ' weeks.')
  WHEN 2 THEN concat('It lasts ', a, ' (', a, ') years, as Amendment No. 3 says.')
  WHEN 3 THEN concat('EUR ', m, ' are owed from ', date_format(d, 'MMMM d, yyyy'), ' on.')
  WHEN 4 THEN concat('The rate is ', pc, ' per cent, counted on ', date_format(d, 'd MMMM yyyy'), '.')
  WHEN 5 THEN concat(a, ' machines stand for ', a + 1, ' hours.')
  WHEN 6 THEN concat('Worth ', a, ' million dollars, or $', a, '.5k a case.')
  WHEN 7 THEN concat('In ', date_format(d, 'MMMM yyyy'), ' lot ', a, 'x was sold at 1,5% of 01/02/2024.')
  ELSE concat('Within ', a, ' fortnights, ', a, ' working days and ', a, ' months.') END"""
#: (way, place in the clause, kind, key).
_FACTS = """
  SELECT 0 AS way, 1 AS n, 'plain' AS kind, '{line}' AS k UNION ALL SELECT 0, 2, 'money', '{m}' UNION ALL SELECT 0, 3, 'date', '{d}' UNION ALL SELECT 1, 1, 'percent', '{pc}' UNION ALL SELECT 1, 2, 'days', '{a}'
  UNION ALL SELECT 2, 1, 'months', '{a}' UNION ALL SELECT 2, 2, 'plain', '3' UNION ALL SELECT 3, 1, 'money', '{m}' UNION ALL SELECT 3, 2, 'date', '{d}' UNION ALL SELECT 4, 1, 'percent', '{pc}'
  UNION ALL SELECT 4, 2, 'date', '{d}' UNION ALL SELECT 5, 1, 'plain', '{a}' UNION ALL SELECT 5, 2, 'clock', '{a1}' UNION ALL SELECT 6, 1, 'money', '{a}000000' UNION ALL SELECT 6, 2, 'money', '{a}500'
  UNION ALL SELECT 7, 1, 'date', '{ym}' UNION ALL SELECT 8, 1, 'days', '{a}' UNION ALL SELECT 8, 2, 'days', '{a}' UNION ALL SELECT 8, 3, 'months', '{a}'"""
_SQL_FACTS = f"""WITH c AS ({_ROWS}), f AS ({_FACTS}),
x AS (SELECT c.*, n, kind, replace(replace(replace(replace(replace(replace(replace(k, '{{line}}', l_linenumber::VARCHAR), '{{m}}', m::VARCHAR), '{{d}}', strftime(d, '%Y-%m-%d')), '{{pc}}', pc::VARCHAR), '{{a1}}', (a + 1)::VARCHAR), '{{a}}', a::VARCHAR),
  '{{ym}}', strftime(d, '%Y-%m')) AS k FROM c JOIN f ON f.way = (l_orderkey + l_linenumber) % 9)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, n))::INT AS place, kind, CASE WHEN kind = 'date' THEN 'd:' ELSE 'n:' END || k AS value_key FROM x"""


@query(_SQL_FACTS)
def typed_facts(t) -> DataFrame:
    """Every value that an order's whole contract states, in order: dates, money, percentages, durations by family, plain numbers."""
    clauses = _lines(t).select("l_orderkey", "l_linenumber", F.expr(_CLAUSE).alias("text"))
    whole = clauses.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return value_support.stated_values(whole, ["l_orderkey"], "text").select("l_orderkey", "place", "kind", "value_key")


#: What each line's answer states of its number, and each line's quote.
_ANSWER = """CASE (l_orderkey + 2 * l_linenumber) % 6 WHEN 0 THEN concat('It takes ', 7 * a, ' days.') WHEN 1 THEN concat('The rate is ', a, '%.') WHEN 2 THEN concat('They name ', a, '.')
  WHEN 3 THEN concat('Under Section ', a, ', ', 12 * a, ' months apply.') WHEN 4 THEN concat('It costs $', a, ' on ', date_format(d, 'd MMMM yyyy'), '.') ELSE concat('It takes ', a, ' hours.') END"""
_QUOTE = """CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN concat(a, ' weeks') WHEN 1 THEN concat(a, ' percent') WHEN 2 THEN concat('number ', a, ' of ', date_format(d, 'MMMM d, yyyy')) WHEN 3 THEN concat(a, ' years')
  WHEN 4 THEN concat('USD ', a, ' on ', date_format(d, 'yyyy-MM-dd')) ELSE concat(60 * a, ' minutes') END"""
_STANDARD = "concat('At least ', a, ' hours, ', 7 * a, ' days or ', a, '% are needed.')"
_SQL_UNQUOTED = f"""WITH c AS (SELECT *, l_orderkey % 7 AS asked, (l_orderkey + 2 * l_linenumber) % 6 AS aw, (l_orderkey + l_linenumber) % 6 AS qw FROM ({_ROWS}) x),
q AS (SELECT l_orderkey, l_linenumber, a::VARCHAR AS v, CASE qw WHEN 0 THEN 'days' WHEN 1 THEN 'percent' WHEN 2 THEN 'plain' WHEN 3 THEN 'months' WHEN 4 THEN 'money' END AS kind,
  CASE qw WHEN 0 THEN 7 * a WHEN 3 THEN 12 * a WHEN 2 THEN NULL ELSE a END AS base FROM c WHERE qw < 5
  UNION ALL SELECT l_orderkey, l_linenumber, (60 * a)::VARCHAR, 'clock', 3600 * a FROM c WHERE qw = 5 UNION ALL SELECT l_orderkey, l_linenumber, 'd' || d, 'date', NULL FROM c WHERE qw IN (2, 4)),
s AS (SELECT l_orderkey, a::VARCHAR AS v, 'clock' AS kind, 3600 * a AS base FROM c WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, (7 * a)::VARCHAR, 'days', 7 * a FROM c WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, a::VARCHAR, 'percent', a FROM c WHERE l_linenumber = 1),
an AS (SELECT l_orderkey, l_linenumber, 1 AS n, CASE aw WHEN 0 THEN 7 * a WHEN 3 THEN 12 * a ELSE a END::VARCHAR AS v, CASE aw WHEN 0 THEN 'days' WHEN 1 THEN 'percent' WHEN 2 THEN 'plain' WHEN 3 THEN 'months' WHEN 4 THEN 'money' ELSE 'clock' END AS kind,
  CASE aw WHEN 0 THEN 7 * a WHEN 2 THEN NULL WHEN 3 THEN 12 * a WHEN 5 THEN 3600 * a ELSE a END AS base FROM c UNION ALL SELECT l_orderkey, l_linenumber, 2, 'd' || d, 'date', NULL FROM c WHERE aw = 4),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, n) AS place, CASE WHEN kind IN ('clock', 'days', 'months') THEN 'duration' ELSE kind END AS family FROM an),
quoted AS (SELECT DISTINCT p.l_orderkey, p.place, p.family FROM placed p JOIN q ON q.l_orderkey = p.l_orderkey AND q.l_linenumber % 2 = 1 AND (q.v = p.v AND (q.kind = p.kind OR q.kind = 'plain' OR p.kind = 'plain') OR q.kind = p.kind AND q.base = p.base)),
standard AS (SELECT DISTINCT p.l_orderkey, p.place FROM placed p JOIN s ON s.l_orderkey = p.l_orderkey AND (s.v = p.v AND (s.kind = p.kind OR p.kind = 'plain') OR s.kind = p.kind AND s.base = p.base)
  WHERE EXISTS (SELECT 1 FROM quoted z WHERE z.l_orderkey = p.l_orderkey AND z.family = p.family))
SELECT l_orderkey, min(place)::INT AS place, CASE WHEN kind = 'date' THEN 'd:' || v[2:] ELSE 'n:' || v END AS value_key, kind FROM placed p
WHERE NOT EXISTS (SELECT 1 FROM quoted z WHERE z.l_orderkey = p.l_orderkey AND z.place = p.place) AND NOT EXISTS (SELECT 1 FROM standard z WHERE z.l_orderkey = p.l_orderkey AND z.place = p.place) GROUP BY l_orderkey, v, kind"""


@query(_SQL_UNQUOTED)
def unquoted_typed_values(t) -> DataFrame:
    """Values of an order's whole answer that none of its odd lines' quotes state as that kind, nor the standard where the answer compares."""
    lines = _lines(t)
    answers = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.expr(_ANSWER).alias("text")))), lambda x: x["text"]), " ").alias("text"))
    quotes = lines.where("l_linenumber % 2 = 1").select("l_orderkey", F.expr(_QUOTE).alias("text"))
    standards = lines.where("l_linenumber = 1").select("l_orderkey", F.expr(_STANDARD).alias("text"))
    return value_support.unquoted_values(answers, quotes, ["l_orderkey"], standards).select("l_orderkey", "place", "value_key", "kind")


_SUBJECT = "element_at(array('Each party', 'The parties', 'Both sides', 'Customer', 'Neither of the parties'), CAST(l_orderkey % 5 AS INT) + 1)"
_SQL_UNIFORM = f"""WITH c AS ({_ROWS}), q AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN a END) AS x, max(CASE WHEN l_linenumber = 2 THEN a END) AS y FROM c GROUP BY 1)
SELECT l_orderkey, 'days' AS kind, 7 * x || ' days' AS used, x || ' weeks; ' || y || ' days' AS offered FROM q WHERE l_orderkey % 5 <> 3 AND x IS NOT NULL AND y IS NOT NULL AND 7 * x <> y AND l_orderkey % 4 <> 1"""


@query(_SQL_UNIFORM)
def uniform_party_claims(t) -> DataFrame:
    """Orders whose answer gives every party the first line's notice while the quotes give two, and none gives it to every party."""
    lines = _lines(t).where("l_linenumber <= 2")
    per = lines.groupBy("l_orderkey").agg(F.max(F.expr("CASE WHEN l_linenumber = 1 THEN a END")).alias("x"), F.max(F.expr("CASE WHEN l_linenumber = 2 THEN a END")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    quotes = F.expr("array(concat('Customer gives notice of ', x, ' weeks.'), concat('Provider gives ', y, ' days.'), CASE WHEN l_orderkey % 4 = 1 THEN concat('Either party may leave on ', x, ' weeks.') END)")
    rows = per.select("l_orderkey", F.expr(f"concat({_SUBJECT}, ' must give ', 7 * x, ' days. Nothing more.')").alias("answer"), quotes.alias("quotes"))
    return value_support.uniform_claims(rows, ["l_orderkey"], "answer", "quotes")
