"""The period grammar over DataFrames: one row a mention, verdicts of sentences against guidance, business weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import period_grammar as grammar

from .distinct import by_distinct

MENTIONS = "array<struct<start:int,stop:int,surface:string,readings:array<decimal(24,6)>,unit:string,end:string,operator:string,denied:string,back:boolean>>"


def read_mentions(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, `mentions`: every period of the text in order, its readings (two where words and figures differ), the end of a
    range that it is, its comparison, the word that denies it, and whether it is counted back from an event."""

    def read(value: str | None):
        r, found = grammar.mentions_of(value or "")
        return (
            [
                {"start": m.start, "stop": m.stop, "surface": m.surface, "readings": list(m.readings), "unit": m.unit, "end": m.end}
                | {"operator": grammar.stated_operator(r, m), "denied": grammar.denied(r, m), "back": grammar.counts_back(r, m)}
                for m in found
            ],
        )

    return by_distinct(df, key, [text], f"mentions {MENTIONS}", read)


def judge(df: DataFrame, key: list[str], text: str, guidance: str, topic: str, week: str) -> DataFrame:
    """key, `outcome`, `reason`: the sentence's first period against the rule that the guidance states about the topic."""

    def read(value, rules, about, days):
        return grammar.verdict(value, *grammar.choose_rule(rules, about), days)

    return by_distinct(df, key, [text, guidance, topic, week], "outcome string, reason string", read)


def definition_weeks(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, `weeks`: what each definition of a business day in the text says of its week; null where it does not say."""
    return by_distinct(df, key, [text], "weeks array<int>", lambda value: (grammar.weeks_in(value),))


def agreed_week(weeks: DataFrame, key: list[str]) -> DataFrame:
    """key, `week`: the week that all definitions of a key agree on; null if one does not say or two differ. Keys without
    a definition have no row."""
    each = weeks.select(*key, F.explode("weeks").alias("w"))
    one: Column = (F.count("*") == F.count("w")) & (F.min("w") == F.max("w"))
    return each.groupBy(*key).agg(F.when(one, F.min("w")).alias("week"))
