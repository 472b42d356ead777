from __future__ import annotations

from decimal import Decimal

import pytest

from lexquarry.functions.periods import periods_in, words_to_number


@pytest.mark.parametrize(("text", "n"), [("thirty", 30), ("one hundred and twenty", 120), ("two thousand five hundred", 2500), ("forty-five", 45), ("and five", None), ("blue", None), ("twenty and one", None)])
def test_number_words(text, n):
    assert words_to_number(text) == n


@pytest.mark.parametrize(
    ("text", "readings", "unit", "operator"),
    [
        ("at least thirty (30) days", [30], "day", "min"),
        ("not more than 10 business days", [10], "business_day", "max"),
        ("ten (12) days", [10, 12], "day", "exact"),
        ("within 1,500 hours", [1500], "hour", "max"),
        ("a 6-month term", [6], "month", "exact"),
    ],
)
def test_periods(text, readings, unit, operator):
    (p,) = periods_in(text)
    assert p["readings"] == [Decimal(r) for r in readings] and (p["unit"], p["operator"]) == (unit, operator)
    assert p["ambiguous"] == (len(readings) > 1)


def test_ranges_and_nothing():
    (p,) = periods_in("3 to 5 years")
    assert p["upper"] == 5 and p["readings"] == [3]
    assert periods_in(None) == [] and periods_in("days and days") == []
