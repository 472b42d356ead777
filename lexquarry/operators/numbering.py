"""Hierarchical list counters, printed forms, and balanced fields, over ordered items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: int) -> str:
    out = ""
    for value, sign in _ROMAN:
        out += sign * (n // value)
        n %= value
    return out


def letters(n: int) -> str:
    """1 -> a, 26 -> z, 27 -> aa, 53 -> aaa: the letter repeats."""
    return chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)


FORMS = {"decimal": str, "zero": lambda n: f"{n:02d}", "lower_roman": roman, "upper_roman": lambda n: roman(n).upper(), "lower_letter": letters, "upper_letter": lambda n: letters(n).upper()}


def printed_numbers(items: list[tuple[int, int | None]], templates: list[tuple[str, str]]) -> list[str | None]:
    """items: (level, start or None) in order; templates: ("%1.%2", form) a level. A level counts one up and resets all deeper ones; a form that refers to a level not counted yet prints nothing."""
    counts: list[int | None] = [None] * len(templates)
    out: list[str | None] = []
    for level, start in items:
        if not 0 <= level < len(templates):
            out.append(None)
            continue
        counts[level] = start if start is not None else (counts[level] or 0) + 1
        counts[level + 1 :] = [None] * (len(templates) - level - 1)
        text: str | None = templates[level][0]
        for k in range(level, -1, -1):
            if text is not None and f"%{k + 1}" in text:
                text = None if counts[k] is None else text.replace(f"%{k + 1}", FORMS[templates[k][1]](counts[k]))
        out.append(text)
    return out


def first_stated(*values: Column) -> Column:
    """A property cascade: the first layer that states a value."""
    return F.coalesce(*values)
