"""Typed values: what a text states, what supports it, and claims about every party."""

from __future__ import annotations

import random

import pytest

from lexquarry.functions import typed_values as v
from lexquarry.operators import value_support


@pytest.mark.parametrize(
    "text, whole, answer",
    [
        ("45 days and $78,600.00 on January 1, 2024", ["days n:45", "money n:78600", "date d:2024-01-01"], None),
        ("one (1) day; thirty (30) days; 30 (thirty) days", ["days n:1", "days n:30", "days n:30"], None),
        ("2024-01-01, 13/01/2024, 1/2/24, 5/5/2023, 01/02/2024", ["date d:2024-01-01", "date d:2024-01-13", "date d:2023-05-05"], None),
        ("$1.5M and 100m, 1st, 1,5% and 1,500%", ["money n:1500000", "percent n:1500"], None),
        ("USD 3 million or 2 billion euros, 10 €", ["money n:3000000", "money n:2000000000", "money n:10"], None),
        ("Section 4.2, 90 days", ["plain n:4.2", "days n:90"], ["days n:90"]),
        ("Sections 1, 2 and 3 set 4 weeks; clause 8.1(a), 7 pumps", ["plain n:1", "plain n:2", "plain n:3", "days n:4", "plain n:8.1", "plain n:7"], ["days n:4", "plain n:7"]),
        ("Amendment No. 1 has 2 renewals and two options", ["plain n:1", "plain n:2", "plain n:2"], ["plain n:2"]),
        ("12th day of March 2025 or March, 2025", ["date d:2025-03-12", "date d:2025-03"], None),
        ("5 per cent, 6 percent, 7%", ["percent n:5", "percent n:6", "percent n:7"], None),
        ("1.2.3.4 and 12345678901234567890123456", [], None),
        ("9‎0 hours", ["clock n:90"], None),
        ("", [], None),
    ],
)
def test_values(text, whole, answer):
    said = lambda a: [f"{x.kind} {x.key}" for x in v.values_in(text, a)]
    assert said(False) == whole and said(True) == (whole if answer is None else answer)
    for x in v.values_in(text):
        assert text[x.start : x.stop].replace("‎", "") == x.surface


def test_equal_in_one_family_only():
    base = lambda text: v.values_in(text)[0].base
    assert base("one year") == base("twelve (12) months") != base("365 days")
    assert base("2 weeks") == base("fourteen days") == base("a 14-day")
    assert base("sixty minutes") == base("1 hour") == base("3,600 seconds")


def plain_unquoted(answer, quotes, standards):
    """The definition, value by value."""
    family = lambda x: "duration" if x.kind in ("clock", "days", "months") else x.kind
    supports = lambda q, x: q.key == x.key and (q.kind == x.kind or "plain" in (q.kind, x.kind)) or q.base is not None and q.base == x.base
    said = v.values_in(answer or "", True)
    quoted = {k for k, x in enumerate(said) if any(supports(q, x) for text in quotes for q in v.values_in(text or ""))}
    compared = {family(said[k]) for k in quoted}
    held = quoted | {k for k, x in enumerate(said) if family(x) in compared and any(supports(q, x) for text in standards for q in v.values_in(text or ""))}
    out = {}
    for k, x in enumerate(said):
        if k not in held:
            out.setdefault((x.key, x.kind), (k + 1, x.surface))
    return {(place, surface, *key) for key, (place, surface) in out.items()}


def test_anti_join_equals_the_definition(spark):
    rng = random.Random(3)
    units = ["days", "weeks", "%", "months", "years", "hours", "minutes", "dollars", "", "machines"]
    text = lambda: ", ".join(f"{rng.choice([1, 2, 7, 12, 14, 24, 60])} {rng.choice(units)}" for _ in range(rng.randrange(0, 6))) + rng.choice(["", " on 2024-03-01", " on March 1, 2024"])
    answers = [(k, text()) for k in range(120)] + [(500, None)]
    quotes = [(k, text()) for k in range(130) for _ in range(rng.randrange(0, 3))] + [(3, None)]
    standards = [(k, text()) for k in range(0, 120, 2)]
    frames = [spark.createDataFrame(rows, "id bigint, text string") for rows in (answers, quotes, standards)]
    for with_standard in (True, False):
        got: dict = {}
        for r in value_support.unquoted_values(frames[0], frames[1], ["id"], frames[2] if with_standard else None).collect():
            got.setdefault(r.id, set()).add((r.place, r.surface, r.value_key, r.kind))
        for k, answer in answers:
            want = plain_unquoted(answer, [q for i, q in quotes if i == k], [s for i, s in standards if i == k and with_standard])
            assert got.get(k, set()) == want, (answer, k)


@pytest.mark.parametrize(
    "answer, quotes, claims",
    [
        ("Each party must give 45 days.", ["Customer must give forty-five (45) days; Provider must give sixty (60) days."], [("days", "45 days", "forty-five (45) days; sixty (60) days")]),
        ("Each party must give 45 days.", ["Either party gives 45 days. Provider gives 60 days."], []),
        ("Customer must give 45 days.", ["Customer gives 45 days; Provider 60 days."], []),
        ("Both Customer and Provider give 2 weeks.", ["Customer 14 days.", "Provider 3 weeks."], [("days", "2 weeks", "14 days; 3 weeks")]),
        ("The parties give 45 days and 60 days.", ["45 days", "60 days"], []),
        (None, ["45 days"], []),
    ],
)
def test_uniform_claims(answer, quotes, claims):
    assert v.uniform_claims(answer, quotes) == claims


def test_long_texts_stay_linear():
    text = "Sections 1, 2, 3 and 4 of 5 days; " * 20_000
    assert len(v.ValueReader(text).values(True)) == 20_000


def test_pieces_of_one_form_are_read_once(monkeypatch):
    """Texts that differ in their figures only are read by the automaton once, and give what it gives for each."""
    rng = random.Random(7)
    parts = "Section no. No Amendment $ EUR € 5 12 0 31 32 007 1997 1,234 12,34 1,234.5 2024-03-05 05/05/2024 13/02/2024 02/13/2024 5/6/2020 003/003/2020 March sept 5th of days weeks months hour % per cent million k $5.5k $3M 100m twenty hundred and , . - / ( ) (5) five 1.2.3 1,5% x".split() + [". ", ".\n"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) + rng.choice("   \t") * rng.randint(0, 1) for _ in range(rng.randint(1, 12)))
        for answer in (False, True):
            whole = [(x.start, x.stop, x.surface, x.key, x.kind, x.base) for x in v.ValueReader(text).values(answer)]
            assert v.rows_in(text, answer) == whole, text
    read, real = [], v.ValueReader
    monkeypatch.setattr(v, "ValueReader", lambda text: read.append(text) or real(text))
    for k in range(100, 900):
        assert [r[3] for r in v.rows_in(f"The fee of ${k} is due in {k} weeks. A rate of {k}.5% holds.")] == [f"n:{k}", f"n:{k}", f"n:{k}.5"]
    assert len(read) <= 2


def test_distinct_rows_are_read_once_a_task(spark):
    from lexquarry.operators.distinct import by_distinct

    spent = spark.sparkContext.accumulator(0)

    def read(text, n):
        spent.add(1)
        return (None if text is None else text * n, n)

    rows = spark.range(0, 40_000, 1, 1).selectExpr("id", "IF(id % 3 = 0, NULL, concat('t', id % 3)) AS text", "CAST(id % 2 AS INT) AS n")
    got = by_distinct(rows, ["id"], ["text", "n"], "twice string, m int", read)
    assert got.where("m <> id % 2 OR NOT twice <=> IF(id % 3 = 0, NULL, repeat(concat('t', id % 3), m))").isEmpty()
    spent.value = 0
    assert got.count() == 40_000 and spent.value == 6
