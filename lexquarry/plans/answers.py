"""What an answer may say of a text: conditions left outside quotes, passages carried forward, marks, handles and times.

The texts are put together from order lines by expressions that both engines read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.session import ensure_checkpoint_dir

from .base import query

LINES = "SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS u, min(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _lines(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("u"), F.min(F.col("l_quantity").cast("bigint")).alias("q"))


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


MARK = "\x01"

# ---------------------------------------------------------------- conditions outside a quote

CONDITIONAL = (
    "concat(CASE p % 4 WHEN 0 THEN 'Subject to clause fourteen, ' WHEN 1 THEN 'Except for the first sixty days, ' WHEN 2 THEN 'However, ' ELSE '' END, "
    "'the customer may end the contract', CASE u % 3 WHEN 0 THEN ' unless fees are due' WHEN 1 THEN ' after notice' ELSE '' END, '. ', "
    "'Fees are paid monthly', CASE q % 2 WHEN 0 THEN ', provided that invoices are correct' ELSE '' END, '. Nothing else.')"
)
QUOTES = ("the customer may end the contract", "Fees are paid monthly", "unless fees are due")
#: Words that open a condition or an exception.
CONDITION_WORDS = ("subject to", "except", "unless", "provided that", "notwithstanding", "however", "only if", "so long as")
CONDITION = rf"(?i:\b(?:{'|'.join(CONDITION_WORDS)})\b)"
#: A condition has words of its own after the one that opens it.
OWN_WORDS = rf"{CONDITION}.*[a-z]{{4}}"
PASSAGE_END = r"([.;!?]\s+)"


def _condition(side):
    """From the first word of condition to the end of that side of the quote, without its trailing signs."""
    rest = F.regexp_extract(side, rf"{CONDITION}.*$", 0)
    return F.when(F.lower(side).rlike(OWN_WORDS), F.regexp_replace(rest, r"[\s,.;:-]+$", ""))




def _sql_side(x: str) -> str:
    return f"CASE WHEN regexp_matches(lower({x}), '{OWN_WORDS}') THEN regexp_replace(regexp_extract({x}, '{CONDITION}.*$', 0), '[\\s,.;:-]+$', '') END"


_SQL_LEFT_OUT = f"""
t AS (SELECT k, n, {CONDITIONAL} AS text FROM ({LINES}) l),
cut AS (SELECT k, n, text, string_split(regexp_replace(text, '{PASSAGE_END}', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM t),
sent AS (SELECT k, n, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i, parts FROM cut),
placed AS (SELECT k, n, sentence, length(array_to_string(parts[1:i-1], '')) AS off FROM sent),
quote AS (SELECT k, n, instr(text, quote) - 1 AS start, instr(text, quote) - 1 + length(quote) AS stop FROM t, (VALUES {", ".join(f"('{x}')" for x in QUOTES)}) v(quote) WHERE contains(text, quote)),
side AS (SELECT q.k, q.n, start, stop, off, substr(sentence, 1, greatest(0, start - off)) AS before_, substr(sentence, stop - off + 1) AS after_
  FROM quote q JOIN placed p ON q.k = p.k AND q.n = p.n AND off < stop AND off + length(sentence) > start),
found AS (SELECT k, n, start, stop, {_sql_side("before_")} AS b, {_sql_side("after_")} AS a,
  off + length(before_) - length(regexp_extract(before_, '{CONDITION}.*$', 0)) AS b_at, stop + length(after_) - length(regexp_extract(after_, '{CONDITION}.*$', 0)) AS a_at FROM side),
out_ AS (SELECT k, n, start, stop, coalesce(b, a) AS written, CASE WHEN b IS NOT NULL THEN b_at ELSE a_at END AS first FROM found WHERE coalesce(b, a) IS NOT NULL)
"""


@query(f"""WITH {_SQL_LEFT_OUT} SELECT k, n, start::INT AS start, written, first::INT AS first,
NOT EXISTS (SELECT 1 FROM quote s WHERE s.k = o.k AND s.n = o.n AND s.start <= o.first AND o.first + length(written) <= s.stop) AS unshown FROM out_ o""")
def conditions_left_out(t) -> DataFrame:
    """Conditions that a quote's own sentence carries outside the quote, and whether another quote shows them.

    Sentences and quotes meet by overlap, conditions and quotes by containment, both within their text.
    """
    ensure_checkpoint_dir(t.spark)
    texts = _lines(t.lineitem).selectExpr("k", "n", f"{CONDITIONAL} AS text")
    parts = F.split(F.regexp_replace("text", PASSAGE_END, "$1" + MARK), MARK)
    cut = texts.withColumn("parts", parts).select("k", "n", "parts", F.posexplode("parts").alias("i", "sentence"))
    placed = cut.select("k", "n", "sentence", F.length(F.array_join(F.slice("parts", F.lit(1), F.col("i")), "")).alias("at"))
    quotes = texts.withColumn("quote", F.explode(F.array(*map(F.lit, QUOTES)))).where(F.contains("text", "quote"))
    quotes = quotes.select("k", "n", (F.instr("text", F.col("quote")) - 1).alias("start"), F.length("quote").alias("size")).withColumn("stop", F.col("start") + F.col("size")).drop("size").checkpoint()
    sides = quotes.join(placed, ["k", "n"]).where("at < stop AND at + length(sentence) > start")
    sides = sides.withColumn("before", F.expr("substring(sentence, 1, greatest(0, start - at))")).withColumn("after", F.expr("substring(sentence, stop - at + 1)"))
    rest = lambda c: F.length(c) - F.length(F.regexp_extract(c, rf"{CONDITION}.*$", 0))
    b, a = _condition(F.col("before")), _condition(F.col("after"))
    found = sides.select("k", "n", "start", F.coalesce(b, a).alias("written"), F.when(b.isNotNull(), F.col("at") + rest("before")).otherwise(F.col("stop") + rest("after")).alias("first")).where("written IS NOT NULL")
    shown = quotes.select("k", "n", F.col("start").alias("s"), F.col("stop").alias("e"))
    covered = found.join(shown, ["k", "n"]).where("s <= first AND first + length(written) <= e").select("k", "n", "start", F.lit(False).alias("unshown")).distinct()
    return found.join(covered, ["k", "n", "start"], "left").select("k", "n", "start", "written", "first", F.coalesce("unshown", F.lit(True)).alias("unshown"))


# ---------------------------------------------------------------- a clause in parts

PART_TEXT = "concat('Unless the fee of line ', CAST(p % 9 AS STRING), ' is due', CASE u % 3 WHEN 0 THEN '.' WHEN 1 THEN ' and so' ELSE concat(' on', chr(10), chr(10), 'time') END)"
PART_HEADING = "CASE q % 4 WHEN 0 THEN 'Fees' ELSE concat('Fees (part ', CAST(n AS STRING), ')') END"
PART_NUMBER = "CAST((n + 1) DIV 2 AS STRING)"
_PART = r"^(.*) \(part \d+\)$"
_ENDS = r"[.!?;][\"'”’)\]]*\s*$"


@query(rf"""
WITH s AS (SELECT k, n, (n + 1) // 2 || '' AS number, {PART_HEADING} AS heading, {PART_TEXT} AS text FROM ({LINES}) l),
w AS (SELECT *, regexp_replace(heading, '{_PART}', '\1') AS base, contains(text, chr(10) || chr(10)) AS parted, regexp_matches(text, '{_sql(_ENDS)}') AS ends FROM s),
v AS (SELECT *, lag(text) OVER o AS text_b, coalesce(lag(number) OVER o = number AND lag(base) OVER o = base AND (lag(heading) OVER o <> base OR heading <> base) AND NOT lag(parted) OVER o AND NOT parted AND NOT lag(ends) OVER o, FALSE) AS from_b,
  lead(text) OVER o AS text_a, coalesce(lead(number) OVER o = number AND lead(base) OVER o = base AND (lead(heading) OVER o <> base OR heading <> base) AND NOT lead(parted) OVER o AND NOT parted AND NOT ends, FALSE) AS into_a FROM w WINDOW o AS (PARTITION BY k ORDER BY n))
SELECT k, n, CASE WHEN from_b THEN text_b || ' ' ELSE '' END || text || CASE WHEN into_a THEN ' ' || text_a ELSE '' END AS reading, (CASE WHEN from_b THEN length(text_b) + 1 ELSE 0 END)::INT AS own_start FROM v
""")
def sentence_continuation(t) -> DataFrame:
    """The text a section's sentences are read in: with the parts of its clause that it runs on from and into."""
    s = _lines(t.lineitem).selectExpr("k", "n", f"{PART_NUMBER} AS number", f"{PART_HEADING} AS heading", f"{PART_TEXT} AS text")
    s = s.withColumn("base", F.regexp_replace("heading", _PART, "$1")).withColumn("parted", F.contains("text", F.lit("\n\n"))).withColumn("ends", F.col("text").rlike(_ENDS))
    order = Window.partitionBy("k").orderBy("n")
    was, next_ = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))

    def one_clause(other):
        same = (other("number") == F.col("number")) & (other("base") == F.col("base")) & ((other("heading") != F.col("base")) | (F.col("heading") != F.col("base")))
        return same & ~other("parted") & ~F.col("parted")

    s = s.select("k", "n", "text", was("text").alias("b"), next_("text").alias("a"), F.coalesce(one_clause(was) & ~was("ends"), F.lit(False)).alias("from_b"), F.coalesce(one_clause(next_) & ~F.col("ends"), F.lit(False)).alias("into_a"))
    lead = F.when(F.col("from_b"), F.concat("b", F.lit(" "))).otherwise("")
    return s.select("k", "n", F.concat(lead, "text", F.when(F.col("into_a"), F.concat(F.lit(" "), "a")).otherwise("")).alias("reading"), F.length(lead).alias("own_start"))


# ---------------------------------------------------------------- a quote taken forward

NOW = "concat(CASE p % 3 WHEN 0 THEN 'Fees: ' ELSE 'The fees: ' END, CAST(u AS STRING), ' a year', CASE q % 5 WHEN 0 THEN '; due; due' WHEN 1 THEN '' ELSE '; due' END)"
BEFORE = "CASE u % 4 WHEN 0 THEN '' WHEN 1 THEN 'e' ELSE 'ees: ' END"
AFTER = "CASE q % 3 WHEN 0 THEN '' ELSE '; due' END"


@query(f"""
WITH e AS (SELECT k, n, {NOW} AS text, {BEFORE} AS before_, {AFTER} AS after_, CASE WHEN p % 2 = 0 THEN 0 ELSE 6 END AS was FROM ({LINES}) l),
f AS (SELECT *, CASE WHEN was = 0 THEN 0 WHEN before_ <> '' AND (length(text) - length(replace(text, before_, ''))) // length(before_) = 1 THEN instr(text, before_) - 1 + length(before_) END AS start FROM e),
g AS (SELECT *, substr(text, start + 1) AS rest FROM f)
SELECT k, n, CASE WHEN start IS NULL THEN NULL WHEN after_ = '' THEN nullif(rest, '') WHEN (length(rest) - length(replace(rest, after_, ''))) // length(after_) = 1 THEN substr(rest, 1, instr(rest, after_) - 1) END AS passage FROM g
""")
def passage_now(t) -> DataFrame:
    """What stands between a quote's recorded surroundings in the present text, where each marks one place; else NULL."""
    e = _lines(t.lineitem).selectExpr("k", "n", f"{NOW} AS text", f"{BEFORE} AS before", f"{AFTER} AS after", "CASE WHEN p % 2 = 0 THEN 0 ELSE 6 END AS was")
    times = lambda text, x: F.expr(f"(length({text}) - length(replace({text}, {x}, ''))) DIV length({x})")
    start = F.when(F.col("was") == 0, 0).when((F.col("before") != "") & (times("text", "before") == 1), F.expr("instr(text, before) - 1 + length(before)"))
    rest = e.withColumn("start", start).withColumn("rest", F.expr("substring(text, start + 1)"))
    passage = F.when(F.col("start").isNull(), None).when(F.col("after") == "", F.expr("nullif(rest, '')")).when(times("rest", "after") == 1, F.expr("substring(rest, 1, instr(rest, after) - 1)"))
    return rest.select("k", "n", passage.alias("passage"))


@query(f"""
WITH o AS (SELECT k, n, u % 3 > 0 AS verified, CASE u % 3 WHEN 1 THEN 'exact' WHEN 2 THEN 'casefold' END AS method FROM ({LINES}) l WHERE p % 7 > 0),
w AS (SELECT k, n, q % 3 > 0 AS verified, CASE q % 3 WHEN 1 THEN 'exact' WHEN 2 THEN 'typed' END AS method FROM ({LINES}) l WHERE p % 11 > 0),
c AS (SELECT coalesce(w.verified, FALSE) AS now_, coalesce(o.verified, FALSE) AS was, w.method IS DISTINCT FROM o.method AS other FROM o FULL JOIN w ON o.k = w.k AND o.n = w.n)
SELECT CASE WHEN now_ AND NOT was THEN 'gained' WHEN was AND NOT now_ THEN 'lost' WHEN now_ AND other THEN 'moved' ELSE 'same' END AS change, count(*)::BIGINT AS spans FROM c GROUP BY 1
""")
def reverify_changes(t) -> DataFrame:
    """Spans of a stored run against those of its replay: gained, lost, moved or same."""
    rows = _lines(t.lineitem)
    old = rows.where("p % 7 > 0").selectExpr("k", "n", "u % 3 > 0 AS was_verified", "CASE u % 3 WHEN 1 THEN 'exact' WHEN 2 THEN 'casefold' END AS was_method")
    new = rows.where("p % 11 > 0").selectExpr("k", "n", "q % 3 > 0 AS verified", "CASE q % 3 WHEN 1 THEN 'exact' WHEN 2 THEN 'typed' END AS method")
    both = old.join(new, ["k", "n"], "full")
    now, was = F.coalesce("verified", F.lit(False)), F.coalesce("was_verified", F.lit(False))
    change = F.when(now & ~was, "gained").when(was & ~now, "lost").when(now & ~F.col("method").eqNullSafe(F.col("was_method")), "moved").otherwise("same")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("spans"))


# ---------------------------------------------------------------- marks, handles, times

MARKED = (
    "CASE p % 6 WHEN 0 THEN 'The cap is [***] here. Fees stand.' WHEN 1 THEN 'The rate, redacted ([***]) in this copy, is unknown. It ends.' "
    "WHEN 2 THEN 'Set at [ * ]% a year; the period is not disclosed. Next, [REDACTED] counts.' WHEN 3 THEN 'Nothing is omitted. The fee is [redacted]! And so on.' "
    "WHEN 4 THEN 'Between [***] and [REDACTED] it is. Done' ELSE 'It is 5%.' END"
)
#: Anything in square brackets; a mark is one that holds only asterisks, or the word.
BRACKETED, MARKS = r"\[[^\[\]]*\]", ("redacted",)
#: How a sentence says that a figure is held back; the first counts with any ending.
HELD_BACK = ("redact", "omitted ", "withheld ", "not disclosed ", "undisclosed ", "not stated ", "cannot be determined ")


def _is_mark(x):
    inside = F.lower(F.btrim(x, F.lit("[] ")))
    return (F.translate(inside, "*", "") == "") & (inside != "") | inside.isin(*MARKS)


def _held_back(sentence):
    """Whether the sentence, its marks aside, says that something is held back."""
    said = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.regexp_replace(sentence, BRACKETED, " ")), F.lit("[a-z]+"), F.lit(0)), " "), F.lit(" "))
    return reduce(Column.__or__, [said.contains(" " + x) for x in HELD_BACK])


_SQL_MARK = "lambda x: (replace(trim(x, '[] '), '*', '') = '' AND trim(x, '[] ') <> '' OR lower(trim(x, '[] ')) IN (" + ", ".join(f"'{m}'" for m in MARKS) + "))"
_SQL_SAID = f"(' ' || array_to_string(regexp_extract_all(lower(regexp_replace(s, '{BRACKETED}', ' ', 'g')), '[a-z]+'), ' ') || ' ')"
_SQL_HELD_BACK = " OR ".join(f"contains({_SQL_SAID}, ' {x}')" for x in HELD_BACK)
STATEMENT_END = r"([.!?])(?:\s+|$)"


@query(f"""
WITH a AS (SELECT k, n, {MARKED} AS text FROM ({LINES}) l),
s AS (SELECT k, n, unnest(string_split(regexp_replace(text, '{STATEMENT_END}', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(text, '{STATEMENT_END}', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM a),
m AS (SELECT k, n, i, s, list_filter(regexp_extract_all(s, '{BRACKETED}'), {_SQL_MARK}) AS marks FROM s WHERE NOT ({_SQL_HELD_BACK})),
g AS (SELECT k, n, i, list_filter(marks, lambda x, j: len(list_filter(marks, lambda y, l: l <> j AND regexp_matches(y, '(?i)redacted'))) = 0) AS given FROM m)
SELECT k, n, min_by(given[1], i) AS mark FROM g WHERE len(given) > 0 GROUP BY k, n
""")
def redaction_as_value(t) -> DataFrame:
    """The first redaction mark that an answer gives as if it were the figure: its sentence does not say it is withheld."""
    a = _lines(t.lineitem).selectExpr("k", "n", f"{MARKED} AS text")
    s = a.select("k", "n", F.posexplode(F.split(F.regexp_replace("text", STATEMENT_END, "$1" + MARK), MARK)).alias("i", "s"))
    s = s.where(~_held_back(F.col("s"))).withColumn("marks", F.filter(F.regexp_extract_all("s", F.lit(BRACKETED), F.lit(0)), _is_mark))
    # another mark of the sentence may say that it is redacted
    given = F.expr("filter(marks, (x, j) -> size(filter(marks, (y, l) -> l <> j AND lower(y) LIKE '%redacted%')) = 0)")
    s = s.withColumn("given", given).where(F.size("given") > 0)
    return s.groupBy("k", "n").agg(F.min_by(F.get("given", F.lit(0)), "i").alias("mark"))


HANDLED = "concat('See sec_', CAST(u % 9 + 1 AS STRING), ' and sec_', CAST(p % 9 + 1 AS STRING), '; not sec_', CAST(q % 12 AS STRING), '.')"
UNREAD = "[a section that was not read]"


@query(f"""
WITH l AS ({LINES}), a AS (SELECT k, n, {HANDLED} AS text FROM l),
label AS (SELECT k, n AS handle, CASE WHEN n = 7 THEN 'the schedule' ELSE '§' || n END AS label FROM l),
p AS (SELECT k, n, text, regexp_extract_all(text, 'sec_(\\d+)', 1) AS h, string_split_regex(text, 'sec_\\d+') AS parts FROM a),
e AS (SELECT k, n, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, h FROM p),
j AS (SELECT e.k, e.n, i, part, i > len(h) AS last, label FROM e LEFT JOIN label ON label.k = e.k AND label.handle = TRY_CAST(h[i] AS INT))
SELECT k, n, string_agg(part || CASE WHEN last THEN '' ELSE coalesce(label, '{UNREAD}') END, '' ORDER BY i) AS text, count(CASE WHEN NOT last AND label IS NULL THEN 1 END)::BIGINT AS unresolved FROM j GROUP BY k, n
""")
def handle_labels(t) -> DataFrame:
    """Handles in an answer written as the labels of their sections; those of none are marked and counted."""
    rows = _lines(t.lineitem)
    a = rows.selectExpr("k", "n", f"{HANDLED} AS text").withColumn("h", F.regexp_extract_all("text", F.lit(r"sec_(\d+)"), F.lit(1)))
    e = a.select("k", "n", "h", F.posexplode(F.split("text", r"sec_\d+", -1)).alias("i", "part")).withColumn("handle", F.get("h", F.col("i")).cast("int"))
    label = rows.selectExpr("k", "n AS handle", "CASE WHEN n = 7 THEN 'the schedule' ELSE concat('§', n) END AS label")
    j = e.join(label, ["k", "handle"], "left").withColumn("last", F.col("i") >= F.size("h"))
    piece = F.concat("part", F.when(F.col("last"), "").otherwise(F.coalesce("label", F.lit(UNREAD))))
    pieces = F.array_sort(F.collect_list(F.struct("i", piece.alias("piece"))))
    return j.groupBy("k", "n").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("text"), F.count_if(~F.col("last") & F.col("label").isNull()).alias("unresolved"))


#: Months, words of a property, words that ask to confirm.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PROPERTY = (
    "due", "payable", "paid", "made", "signed", "dated", "effective", "expiring", "expires", "ending", "ends", "starting", "starts", "commencing", "commences",
    "beginning", "begins", "delivered", "received", "given", "served", "issued", "executed", "entered", "held", "scheduled", "falling", "falls", "occurring", "occurs",
    "terminating", "terminates", "renewing", "renews", "closing", "closes", "sent", "filed",
)
CONFIRMING = ("is", "are", "was", "were", "does", "do", "did", "can", "could", "will", "would", "must", "has", "have", "had", "should", "shall", "may", "might")
ASKED = (
    "CASE p % 8 WHEN 0 THEN concat('What was the fee in June ', CAST(2020 + u % 7 AS STRING), '?') WHEN 1 THEN concat('Is the fee payable in ', CAST(2020 + u % 7 AS STRING), '?') "
    "WHEN 2 THEN 'How much is due on 1 March 2027?' WHEN 3 THEN concat('Which cap applied during the financial year ', CAST(1990 + u % 9 AS STRING), ' and as of 2025-03-01?') "
    "WHEN 4 THEN 'In 2024, does the cap apply?' WHEN 5 THEN 'When, on March 5, 2026, did it end?' WHEN 6 THEN 'What holds after 2000 hours?' ELSE 'What is owed at 2019 and in May 2018?' END"
)
_MONTH = f"(?:{'|'.join(MONTHS)})"
#: Some words and a time after them: a day, a month or a year.
TIMED = rf"((?:[\w'-]+\s+){{0,9}}?)(\d{{4}}-\d{{2}}-\d{{2}}|(?:\d{{1,2}}\s+)?{_MONTH}\s+(?:\d{{1,2}},\s+)?\d{{4}}|(?:19|20)\d{{2}})\b"
#: Words that set a question in a time, and those that may stand between them and it.
FRAMING, BETWEEN = ("in", "during", "throughout", "on", "at"), ("the", "calendar", "financial", "fiscal", "year")
LEADING = 62  # characters within which a clause before the question ends at its comma


def _frames(lead):
    """Whether the words before a time set the question in it: the last is a framing word, or "as of" and "as at", and the
    word before is no property of what is asked about."""
    w = F.filter(F.split(F.lower(F.trim(lead)), r"\s+"), lambda x: ~x.isin(*BETWEEN))
    back = lambda k: F.coalesce(F.try_element_at(w, F.lit(-k)), F.lit(""))
    of = (back(2) == "as") & back(1).isin("of", "at")
    return (of | back(1).isin(*FRAMING)) & ~F.when(of, back(3)).otherwise(back(2)).isin(*PROPERTY)


def _confirms(text):
    """Whether a question asks to confirm: it, or what follows a leading clause of time, begins with an auxiliary verb."""
    first = lambda x: F.lower(F.regexp_extract(x, "[A-Za-z]+", 0))
    comma = F.instr(text, ",")
    led = first(text).isin(*FRAMING, "as") & comma.between(1, LEADING) & first(F.expr("substring(text, instr(text, ',') + 1)")).isin(*CONFIRMING)
    return first(text).isin(*CONFIRMING) | led


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_SQL_W = rf"list_filter(string_split_regex(lower(trim(x[1])), '\s+'), lambda y: y NOT IN {_in(BETWEEN)})"
_SQL_OF = f"(coalesce({_SQL_W}[-2], '') = 'as' AND coalesce({_SQL_W}[-1], '') IN ('of', 'at'))"
_SQL_FRAMES = f"(({_SQL_OF} OR coalesce({_SQL_W}[-1], '') IN {_in(FRAMING)}) AND CASE WHEN {_SQL_OF} THEN coalesce({_SQL_W}[-3], '') ELSE coalesce({_SQL_W}[-2], '') END NOT IN {_in(PROPERTY)})"
_SQL_FIRST = "lower(regexp_extract({x}, '[A-Za-z]+'))"
_SQL_CONFIRMS = (
    f"({_SQL_FIRST.format(x='text')} IN {_in(CONFIRMING)} OR {_SQL_FIRST.format(x='text')} IN {_in((*FRAMING, 'as'))} AND instr(text, ',') BETWEEN 1 AND {LEADING} "
    f"AND {_SQL_FIRST.format(x="substr(text, instr(text, ',') + 1)")} IN {_in(CONFIRMING)})"
)


@query(f"""
WITH a AS (SELECT k, n, {ASKED} AS text FROM ({LINES}) l)
SELECT k, n, array_to_string(CASE WHEN {_SQL_CONFIRMS} THEN []::VARCHAR[] ELSE
  list_transform(list_filter(list_zip(regexp_extract_all(text, '{_sql(TIMED)}', 1), regexp_extract_all(text, '{_sql(TIMED)}', 2)), lambda x: {_SQL_FRAMES}), lambda x: x[2]) END, '|') AS times FROM a
""")
def frame_times(t) -> DataFrame:
    """The times a question asks at, as written; none of a question that asks to confirm, none given as a property."""
    a = _lines(t.lineitem).selectExpr("k", "n", f"{ASKED} AS text")
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(TIMED), F.lit(1)).alias("before"), F.regexp_extract_all("text", F.lit(TIMED), F.lit(2)).alias("time"))
    own = F.transform(F.filter(found, lambda x: _frames(x["before"])), lambda x: x["time"])
    return a.select("k", "n", F.when(_confirms(F.col("text")), "").otherwise(F.array_join(own, "|")).alias("times"))


#: Sources whose status rests on a comparison by code, and the wordings that say so or name what went unseen.
COMPARED_SOURCES = ("computed_days", "confirmed_days", "ambiguous_fact")
COMPARED_WORDING = "code compared the period"
REASONS = "CASE q % 4 WHEN 0 THEN 'code compared the period with the rule' WHEN 1 THEN concat('points at §', CAST(p % 9 AS STRING), ', which was not handed to the model') ELSE '' END"
SOURCES = "CASE u % 4 WHEN 0 THEN 'computed_days' WHEN 1 THEN 'model_hint' WHEN 2 THEN 'ambiguous_fact' ELSE 'reference_check' END"
UNSEEN_WORDING = r"points at (?:§[\d.]+|[A-Z]\w+ \w+), which was not handed to the model"


@query(f"""
WITH a AS (SELECT k, n, {SOURCES} AS source, {REASONS} AS reason FROM ({LINES}) l)
SELECT k, n, source IN {COMPARED_SOURCES} OR (source = 'model_hint' AND contains(reason, '{COMPARED_WORDING}')) AS compared, nullif(regexp_extract(reason, '{UNSEEN_WORDING}', 0), '') AS unseen FROM a
""")
def status_basis(t) -> DataFrame:
    """What a finding's status rests on, read back from its source and reason: never more than the record says."""
    a = _lines(t.lineitem).selectExpr("k", "n", f"{SOURCES} AS source", f"{REASONS} AS reason")
    compared = F.col("source").isin(*COMPARED_SOURCES) | ((F.col("source") == "model_hint") & F.contains("reason", F.lit(COMPARED_WORDING)))
    a = a.withColumn("said", F.regexp_extract("reason", UNSEEN_WORDING, 0))
    return a.select("k", "n", compared.alias("compared"), F.expr("nullif(said, '')").alias("unseen"))
