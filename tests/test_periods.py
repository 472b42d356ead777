"""The period grammar: every number in words, one statement of several periods, what is said about them, rules, calendars."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest

from lexquarry.functions import period_grammar as g
from lexquarry.operators import period_reading


def spelled(n):
    small = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    if n < 20:
        return small[n]
    if n < 100:
        return tens[n // 10 - 2] + (f"-{small[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{small[n // 100]} hundred" + (f" and {spelled(n % 100)}" if n % 100 else "")
    return f"{spelled(n // 1000)} thousand" + (f" {spelled(n % 1000)}" if n % 1000 else "")


def read(text):
    return [([int(v) for v in m.readings], m.unit, m.end) for m in g.mentions_of(text)[1]]


def test_every_number_in_words():
    for n in [*range(1, 1300), 2500, 99_999, 120_120]:
        assert read(f"It takes {spelled(n)} days.") == [([n], "day", None)], spelled(n)
        assert read(f"{spelled(n).capitalize()} ({n:,}) months") == [([n], "month", None)]
        if n > 20:
            assert read(f"{n} ({spelled(n - 1)}) weeks") == [([n, n - 1], "week", None)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("thirty and sixty days", [([30], "day", None), ([60], "day", None)]),
        ("between 30 and 90 days", [([30], "day", "low"), ([90], "day", "high")]),
        ("30-90 days", [([30], "day", "low"), ([90], "day", "high")]),
        ("from ten to twelve weeks", [([10], "week", "low"), ([12], "week", "high")]),
        ("30, 60 or 90 days", [([30], "day", None), ([60], "day", None), ([90], "day", None)]),
        ("a fortnight", [([2], "week", None)]),
        ("1,095 days; 9‎0 days", [([1095], "day", None), ([90], "day", None)]),
        ("Section 12 and 30 days, no. 4 and 2 years", [([30], "day", None), ([2], "year", None)]),
        ("5% and 3 years, $7 or 8 weeks", [([3], "year", None), ([8], "week", None)]),
        ("several days, 30 and nothing else", []),
        ("forty‑five (45) working days", [([45], "business_day", None)]),
        ("", []),
        ("12.5 days and x30 days", [([12], "day", None)]),
    ],
)
def test_mentions(text, found):
    assert read(text) == found


def test_places_index_the_text_as_written():
    text = "In 9‎0 days‍ or thirty‑one (31) weeks"
    assert [text[m.start : m.stop] for m in g.mentions_of(text)[1]] == ["9‎0 days", "thirty‑one (31) weeks"]


@pytest.mark.parametrize(
    "text, operators",
    [
        ("at least 30 and no more than 90 days", ["min", "max"]),
        ("not less than 30 nor more than 60 days", ["min", "max"]),
        ("no later than 30 days before the end", ["min"]),
        ("no later than 30 days after the end", ["max"]),
        ("30 days or more, 60 days at the most", ["min", "max"]),
        ("less than 20 days", ["max"]),
        ("exactly 20 days", ["exact"]),
        ("within 10 days. 20 days", ["max", None]),
    ],
)
def test_operators(text, operators):
    r, found = g.mentions_of(text)
    assert [g.stated_operator(r, m) for m in found] == operators


@pytest.mark.parametrize(
    "text, word",
    [
        ("is not required to give 30 days’ notice", "not"),
        ("not less than 30 days", None),
        ("without 30 days’ notice", "without"),
        ("without cause upon 30 days’ notice", None),
        ("waives the 30 days", "waives"),
        ("30 days are never enough", "never"),
        ("It may not end. 30 days pass", None),
    ],
)
def test_denials(text, word):
    r, found = g.mentions_of(text)
    assert g.denied(r, found[0]) == word


def rule(text, topic="termination notice"):
    found = g.choose_rule(text, topic)[0]
    return found and (found.operator, int(found.value), found.unit, found.ceiling and (int(found.ceiling[0]), found.ceiling[1]), len(found.others))


@pytest.mark.parametrize(
    "text, want",
    [
        ("Payment terms are 30 days. Termination needs at least 90 days’ notice.", ("min", 90, "day", None, 0)),
        ("Payment terms are 30 days. Audits take 2 weeks.", ("min", 30, "day", None, 0)),
        ("between 30 and 90 days", ("min", 30, "day", (90, "day"), 0)),
        ("between 90 and 30 days", None),
        ("at least 30 days’ notice, or 90 days for some", ("min", 30, "day", None, 1)),
        ("30, 60 or 90 days", None),
        ("thirty (60) days", None),
        ("must not be at least 60 days", None),
        ("less than 60 days", None),
        ("more than 60 days are not acceptable", None),
        ("about 60 days or less", ("max", 60, "day", None, 0)),
        ("Termination notice is thirty (60) days. Payment is due in 30 days.", None),
        ("in writing", None),
    ],
)
def test_rules(text, want):
    assert rule(text) == want


def test_month_spans_equal_all_start_dates():
    def plain(months):
        spans = []
        for k in range((datetime.date(2128, 1, 1) - datetime.date(2072, 1, 1)).days):
            d = datetime.date(2072, 1, 1) + datetime.timedelta(k)
            y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
            last = (datetime.date(y + (m == 11), (m + 1) % 12 + 1, 1) - datetime.timedelta(1)).day
            spans.append((datetime.date(y, m + 1, min(d.day, last)) - d).days)
        return min(spans), max(spans)

    assert all(g.month_days(m) == plain(m) for m in (1, 2, 5, 12, 18, 48))


def test_verdicts_hold_on_every_calendar():
    of = lambda text, guidance, week=None: g.verdict(text, *g.choose_rule(guidance, "notice"), week)[0]
    assert of("30 days’ notice", "at least 30 days’ notice") == "pass"
    assert of("one month’s notice", "at least 30 days’ notice") == "incomparable"
    assert of("one month’s notice", "at least 28 days’ notice") == "pass"
    assert of("one month’s notice", "at least 32 days’ notice") == "needs_review"
    assert of("30 business days’ notice", "at least 40 days’ notice", 5) == "pass"
    assert of("10 business days’ notice", "at most 40 days’ notice", 5) == "incomparable"
    assert of("thirty (60) days’ notice", "at least 10 days’ notice") == "ambiguous"
    assert of("may terminate immediately", "at least 10 days’ notice") == "needs_review"
    assert of("may terminate immediately", "at most 10 days’ notice") == "pass"
    assert of(None, "at most 10 days’ notice") == of("40 days", None) == "incomparable"


def test_generated_statements(spark):
    """Statements of one to four numbers with a shared unit, joined and compared at random."""
    rng, rows, want = random.Random(9), [], []
    for k in range(400):
        n = [rng.randrange(1, 400) for _ in range(rng.randrange(1, 5))]
        unit, name = rng.choice([("days", "day"), ("working days", "business_day"), ("weeks", "week"), ("years", "year")])
        written = [rng.choice([str(v), spelled(v), f"{spelled(v)} ({v})"]) for v in n]
        joined = written[0]
        for w in written[1:]:  # "two hundred and five" is one number
            joined += rng.choice([", ", " or ", " but no more than "] + [" and "] * (not joined.endswith("hundred"))) + w
        rows.append((k, f"The parties, after a while, wait {joined} {unit}. Then 7 follow."))
        want += [(k, p, v, name) for p, v in enumerate(n)]
    df = spark.createDataFrame(rows, "k bigint, t string").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "k bigint, t string"))
    got = [(r.k, p, int(m.readings[0]), m.unit) for r in period_reading.read_mentions(df, ["k"], "t").collect() for p, m in enumerate(r.mentions)]
    assert sorted(got) == sorted(want)


def test_long_texts_stay_linear():
    text = "one hundred and " * 20_000 + "30 and " * 20_000 + "90 days"
    found = g.Reader(text).mentions()
    assert found[-1].readings == (Decimal(90),) and found[-1].unit == "day"


def test_weeks(spark):
    for text, weeks in (("Business Day means a day other than a Saturday or Sunday. Working Day means Monday to Saturday.", [5, 6]), ("nothing", []), (None, []), ("A business day is a day when banks open", [None])):
        assert g.weeks_in(text) == weeks
    df = spark.createDataFrame([(1, "Business Day means Monday to Friday."), (1, "Working days are days excluding weekends."), (2, "Business Day means Monday to Friday."), (2, "Business Day is any day."), (3, "None.")], "k int, t string")
    got = period_reading.agreed_week(period_reading.definition_weeks(df, ["k"], "t"), ["k"]).collect()
    assert sorted((r.k, r.week) for r in got) == [(1, 5), (2, None)]
