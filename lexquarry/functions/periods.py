"""Periods and other stated values: reading them in text, and comparing them as calendar intervals.

A period keeps its unit: months and business days are never turned into days. Comparison is by interval order: a period
meets a bound only if it does on every calendar, misses it only if it does on every calendar, and is incomparable else.
"""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number words and units.
SMALL = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = {w: n for n, w in enumerate(SMALL)} | {w: 20 + 10 * k for k, w in enumerate(TENS)} | {"hundred": 100, "thousand": 1000}
UNITS = ("business day", "working day", "calendar day", "day", "week", "month", "quarter", "year", "hour")
AT_LEAST = ("at least", "not less than", "no less than", "minimum of", "no fewer than", "not fewer than", "or more", "or longer")
AT_MOST = ("at most", "not more than", "no more than", "maximum of", "within", "not exceed", "up to", "not later than", "no later than", "or less", "or fewer")
_WORD = "(?:" + "|".join(NUMBER_WORDS) + ")"
_WORDS = rf"{_WORD}(?:(?:[\s-]+(?:and\s+)?){_WORD})*"
_DIGITS = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_UNIT = r"(?P<unit>(?:business|working|calendar)[\s-]+days?|days?|weeks?|months?|quarters?|years?|hours?)"
_PERIOD = re.compile(
    rf"\b(?:(?P<words>{_WORDS})\s*\(\s*(?P<inner>{_DIGITS})\s*\)|(?P<digits>{_DIGITS})\s*(?:\(\s*(?P<spelled>{_WORDS})\s*\))?|(?P<alone>{_WORDS}))"
    rf"(?:\s*(?:-|–|to)\s*(?P<upper>{_DIGITS}))?[\s-]*(?:(?:full|consecutive|clear)\s+)?{_UNIT}\b",
    re.IGNORECASE,
)


def words_to_number(text: str) -> int | None:
    """'one hundred and twenty' -> 120; None if a word is unknown or the words do not compose."""
    total = group = 0
    seen = False
    before = ""
    for w in re.findall(r"[a-z]+", text.lower()):
        if w == "and":
            if before not in ("hundred", "thousand"):
                return None
        elif (n := NUMBER_WORDS.get(w)) is None:
            return None
        elif n == 100:
            group = (group or 1) * 100
        elif n == 1000:
            total, group = total + (group or 1) * 1000, 0
        elif seen and before in NUMBER_WORDS and NUMBER_WORDS[before] < 20 and before != "and" or (n >= 20 and group % 100):
            return None
        else:
            group += n
        before, seen = w, True
    return total + group if seen else None


def unit_of(text: str) -> str:
    u = re.sub(r"[\s-]+", " ", text.lower()).rstrip("s")
    if u in ("business day", "working day"):
        return "business_day"
    return "day" if u == "calendar day" else u


def _decimal(text: str) -> Decimal | None:
    try:
        return Decimal(text.replace(",", ""))
    except InvalidOperation:
        return None


def periods_in(text: str | None) -> list[dict]:
    """Every period: its place, its readings (two if words and digits differ), its unit, a range's end, its operator."""
    out = []
    for m in _PERIOD.finditer(text or ""):
        spelled, figures = m["words"] or m["spelled"] or m["alone"], m["inner"] or m["digits"]
        readings = []
        if spelled and (n := words_to_number(spelled)) is not None:
            readings.append(Decimal(n))
        if figures and (d := _decimal(figures)) is not None and d not in readings:
            readings.append(d)
        if not readings:
            continue
        low, high = text[max(0, m.start() - 40) : m.start()].lower(), text[m.end() : m.end() + 24].lower()
        place = {op: max((low.rfind(p) for p in ps), default=-1) for op, ps in (("min", AT_LEAST), ("max", AT_MOST))}
        op = max(place, key=lambda k: (place[k], k)) if max(place.values()) >= 0 else None
        if op is None:
            op = "min" if any(p in high for p in AT_LEAST) else "max" if any(p in high for p in AT_MOST) else "exact"
        out.append(
            {"start": m.start(), "stop": m.end(), "surface": m[0], "readings": readings, "unit": unit_of(m["unit"]), "upper": _decimal(m["upper"]) if m["upper"] else None, "operator": op, "ambiguous": len(readings) > 1}
        )
    return out


PERIOD_TYPE = "array<struct<start:int,stop:int,surface:string,readings:array<decimal(24,6)>,unit:string,upper:decimal(24,6),operator:string,ambiguous:boolean>>"


def read_periods(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, periods; distinct texts are read once a batch."""

    def run(batches):
        for batch in batches:
            known: dict = {}
            found = [known[t] if t in known else known.setdefault(t, periods_in(t)) for t in batch.column(1).to_pylist()]
            item = pa.struct(
                [("start", pa.int32()), ("stop", pa.int32()), ("surface", pa.string()), ("readings", pa.list_(pa.decimal128(24, 6))), ("unit", pa.string()), ("upper", pa.decimal128(24, 6)), ("operator", pa.string()), ("ambiguous", pa.bool_())]
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], names=["id", "periods"])

    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, periods {PERIOD_TYPE}")


def in_days(value: Column, unit: Column) -> Column:
    """Exact days, where a unit has them."""
    return F.when(unit == "day", value).when(unit == "week", value * 7)


def same_period(av: Column, au: Column, bv: Column, bu: Column) -> Column:
    return F.coalesce((au == bu) & (av == bv), F.lit(False)) | F.coalesce(in_days(av, au) == in_days(bv, bu), F.lit(False))


def month_spans(spark, most: int) -> DataFrame:
    """months, lo, hi: the fewest and most days that a number of months has from any start date of 2072 to 2127."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2072-01-01").cast("date"), F.lit("2127-12-31").cast("date"))).alias("d"))
    spans = days.select("d", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("months")).withColumn("n", F.datediff(F.add_months("d", F.col("months")), F.col("d")))
    return spans.groupBy("months").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))


def calendar_low(value: Column, unit: Column, week: int, lo: Column) -> Column:
    """Fewest calendar days; lo: that of the value's months."""
    n = F.ceil(value)
    return F.when(unit == "business_day", F.greatest(F.lit(0), n + (7 - week) * F.floor((n - 1) / week))).when(unit.isin("month", "year", "quarter"), lo).otherwise(in_days(value, unit))


def compare(operator: Column, alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """pass, needs_review or incomparable for an observed interval [alo, ahi] against a bound [blo, bhi]; NULL high: no upper bound."""
    at_least = F.when(F.coalesce(alo >= bhi, F.lit(False)), "pass").when(F.coalesce(ahi < blo, F.lit(False)), "needs_review")
    at_most = F.when(F.coalesce(ahi <= blo, F.lit(False)), "pass").when(F.coalesce(alo > bhi, F.lit(False)), "needs_review")
    exact = F.when(F.coalesce((alo == ahi) & (blo == bhi) & (alo == blo), F.lit(False)), "pass").when(F.coalesce((ahi < blo) | (alo > bhi), F.lit(False)), "needs_review")
    return F.coalesce(F.when(operator == "min", at_least).when(operator == "max", at_most).otherwise(exact), F.lit("incomparable"))
