"""A grammar of periods in text: mentions, what is said about them, guidance sentences as rules, business weeks.

Text is cut into tokens once. A small automaton reads numbers, in figures or words, a restatement in brackets and a unit;
numbers that only joining and comparing words part are one statement and share the unit written last. What compares or
denies a period is looked for among the tokens between its neighbours. A period keeps its unit; comparison is by the
fewest and most calendar days that it can take.

Null and empty texts hold no period. A text is read in one pass, and each token is looked at a bounded number of times.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import lru_cache

import numpy as np

from .periods import NUMBER_WORDS

# Units by their words, and the words that join, compare, deny, point and bound.
UNITS = {"day": "day", "week": "week", "fortnight": "fortnight", "month": "month", "year": "year"}
DAY_KINDS = {"calendar": "day", "business": "business_day", "working": "business_day"}
JOINERS = frozenset(", - & and or to through thru until nor but".split())
RANGE_JOINERS = frozenset("- to through thru until".split())
COMPARING = frozenset("no not never at most least more less fewer greater longer shorter than maximum minimum max min up exceed exceeds exceeding under over above below within equal".split())
ARTICLES = frozenset(("a", "an", "the", "of"))
POINTING = frozenset("section sections clause clauses article articles schedule schedules exhibit exhibits annex annexes appendix paragraph paragraphs item items part parts rule rules no nos number § # $ € £ ¥".split())
FLOORS = tuple(p.split() for p in ("at least", "not less than", "no less than", "not fewer than", "no fewer than", "nor less than", "never less than", "minimum of", "minimum", "no shorter than", "not shorter than"))
CEILINGS = tuple(p.split() for p in ("at most", "not more than", "no more than", "not longer than", "no longer than", "never more than", "maximum of", "maximum", "within", "up to", "limited to", "capped at", "not exceed", "not exceeding", "not to exceed", "not later than", "no later than", "nor more than"))
STRICTLY_ABOVE = tuple(p.split() for p in ("more than", "longer than", "greater than", "over", "above", "beyond", "in excess of", "exceeding", "exceeds"))
STRICTLY_BELOW = tuple(p.split() for p in ("less than", "fewer than", "shorter than", "under", "below"))
CLOSING_FLOORS = tuple(p.split() for p in ("or more", "or longer", "at least", "at the least", "minimum", "or greater"))
CLOSING_CEILINGS = tuple(p.split() for p in ("or less", "or fewer", "or shorter", "at most", "at the most", "maximum"))
EXACTLY = (["exactly"], ["precisely"], ["equal", "to"])
NEGATIONS = frozenset("not no never nor neither cannot without waive waives waived".split())
AFTER_EVENT = (["before"], ["prior", "to"], ["ahead", "of"], ["preceding"])
NO_NOTICE = tuple(p.split() for p in ("immediately", "with immediate effect", "without notice", "without prior notice", "no notice"))
NOTICE_STEMS = ("notice", "notif", "terminat", "cancel")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_TOKEN = re.compile(r"[^\W\d_]+|\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)|\d+(?:\.\d+)?|[^\w\s]|_")
_DASHES = "‐‑‒–—―−﹘﹣－"
_STOP = frozenset(".;!?")
#: Characters in which words before and after a period are about it, and between two numbers of one statement.
BEFORE, AFTER, BETWEEN, DENIAL = 40, 24, 40, 80


@dataclass(frozen=True)
class Token:
    word: str
    start: int
    stop: int

    @property
    def number(self) -> Decimal | None:
        return Decimal(self.word.replace(",", "")) if self.word[0].isdigit() else None


@dataclass(frozen=True)
class Mention:
    start: int
    stop: int
    surface: str
    readings: tuple[Decimal, ...]
    unit: str
    end: str | None = None  # low or high: an end of a range
    first: int = 0  # tokens that are about it: from the period before to the one after
    last: int = 0
    at: tuple[int, int] = (0, 0)  # its own tokens

    @property
    def ambiguous(self) -> bool:
        return len(self.readings) > 1


def visible(text: str) -> tuple[str, list[int] | None]:
    """What a reader sees, dashes as hyphens, with the place of each character; None where nothing was dropped."""
    plain = text.translate(dict.fromkeys(map(ord, _DASHES), "-"))
    if plain.isascii() or not any(unicodedata.category(c) == "Cf" for c in plain):
        return plain, None
    kept = [i for i, c in enumerate(plain) if unicodedata.category(c) != "Cf"]
    return "".join(plain[i] for i in kept), kept


def tokens_of(text: str) -> list[Token]:
    return [Token(m[0].lower(), *m.span()) for m in _TOKEN.finditer(text)]


class Reader:
    """The automaton over one text's tokens."""

    def __init__(self, text: str):
        self.text, self.places = visible(text)
        self.tokens = tokens_of(self.text)

    def word(self, i: int) -> str:
        return self.tokens[i].word if 0 <= i < len(self.tokens) else ""

    def _skip(self, i: int) -> int:
        return i + 1 if self.word(i) == "-" else i

    def _under_hundred(self, i: int) -> tuple[int, int] | None:
        n = NUMBER_WORDS.get(self.word(i))
        if n is None or n >= 100:
            return None
        j = self._skip(i + 1)
        ones = NUMBER_WORDS.get(self.word(j), 0)
        return (n + ones, j + 1) if n >= 20 and 1 <= ones <= 9 else (n, i + 1)

    def _with_rest(self, n: int, i: int, rest) -> tuple[int, int]:
        j = self._skip(i)
        if self.word(j) == "and":
            j = self._skip(j + 1)
        found = rest(j)
        return (n + found[0], found[1]) if found else (n, i)

    def _under_thousand(self, i: int) -> tuple[int, int] | None:
        n, j = self._under_hundred(i) or (1, i)
        k = self._skip(j) if j > i else j
        if self.word(k) == "hundred":
            return self._with_rest(n * 100, k + 1, self._under_hundred)
        return (n, j) if j > i else None

    def in_words(self, i: int) -> tuple[int, int] | None:
        """(value, token after) of a number in words; "and" joins only after hundred or thousand."""
        n, j = self._under_thousand(i) or (1, i)
        k = self._skip(j) if j > i else j
        if self.word(k) == "thousand":
            return self._with_rest(n * 1000, k + 1, self._under_thousand)
        return (n, j) if j > i else None

    def unit(self, i: int) -> tuple[str, int] | None:
        while self.word(i) == "-":
            i += 1
        kind = DAY_KINDS.get(self.word(i))
        if kind and self.word(i + 1) in ("day", "days"):
            return kind, i + 2
        name = self.word(i)
        name = name[:-1] if name.endswith("s") else name
        return (UNITS[name], i + 1) if name in UNITS else None

    def statement(self, i: int):
        """(readings, unit or None, token after) of the number at token i, or None."""
        figures, spelled, article = self.tokens[i].number, None, False
        j = i + 1
        if figures is None:
            found = self.in_words(i)
            if found:
                spelled, j = Decimal(found[0]), found[1]
            elif self.word(i) in ("a", "an"):
                spelled, article = Decimal(1), True
            else:
                return None
        elif i and (self.tokens[i - 1].stop == self.tokens[i].start and self.word(i - 1) not in ("(", "-", "$", "€", "£", "¥", "#", "§", "'", "’", "“", '"')):
            return None  # a part of another number or word
        if self.word(j) == "(":
            inner = self.tokens[j + 1].number if figures is None and j + 1 < len(self.tokens) else None
            words = self.in_words(j + 1) if figures is not None else None
            if inner is not None and self.word(j + 2) == ")":
                figures, j = inner, j + 3
            elif words and self.word(words[1]) == ")":
                spelled, j = Decimal(words[0]), words[1] + 1
        unit = self.unit(j)
        if article and unit is None:
            return None
        readings = tuple(dict.fromkeys(x for x in (figures, spelled) if x is not None))
        return readings, (unit[0] if unit else None), (unit[1] if unit else j)

    def statements(self) -> list[tuple[int, int, tuple, str | None]]:
        out, i = [], 0
        while i < len(self.tokens):
            found = self.statement(i)
            if found is None:
                i += 1
                continue
            readings, unit, j = found
            points = self.word(i - 1) in POINTING or self.word(i - 1) == "." and self.word(i - 2) in ("no", "nos")
            rated = self.word(j) in ("%", "percent") or self.word(j) == "per" and self.word(j + 1) == "cent"
            longer = j < len(self.tokens) and self.tokens[j].start == self.tokens[j - 1].stop and (self.word(j)[0].isalnum() or self.word(j) == "%")
            if unit or not (points or rated or longer):
                out.append((i, j, readings, unit))
            i = j
        return out

    def _together(self, a: int, b: int) -> bool:
        """Whether tokens a..b, between two numbers, only join and compare."""
        if self.tokens[b].start - self.tokens[a - 1].stop > BETWEEN:
            return False
        between = [t.word for t in self.tokens[a:b] if t.word not in ("'", "’")]
        return any(w in JOINERS for w in between) and all(w in JOINERS or w in COMPARING or w in ARTICLES for w in between)

    def mentions(self) -> list[Mention]:
        found = self.statements()
        if not any(unit for *_, unit in found):
            return []
        groups: list[list] = []
        for s in found:
            if groups and self._together(groups[-1][-1][1], s[0]):
                groups[-1].append(s)
            else:
                groups.append([s])
        out: list[Mention] = []
        for group in groups:
            unit, read = None, []
            for i, j, readings, own in reversed(group):
                unit = own or unit
                if unit:
                    value, named = (tuple(2 * r for r in readings), "week") if unit == "fortnight" else (readings, unit)
                    start, stop = self.tokens[i].start, self.tokens[j - 1].stop
                    surface = self.text[start:stop]
                    if self.places is not None:
                        start, stop = self.places[start], self.places[stop - 1] + 1
                    read.append(Mention(start, stop, surface, value, named, at=(i, j)))
            read.reverse()
            if len(read) == 2:
                between = [t.word for t in self.tokens[read[0].at[1] : read[1].at[0]]]
                if len(between) == 1 and (between[0] in RANGE_JOINERS or between == ["and"] and self.word(read[0].at[0] - 1) in ("between", "from")):
                    read = [replace(read[0], end="low"), replace(read[1], end="high")]
            out += read
        ends = [0, *(m.at[1] for m in out)]
        starts = [*(m.at[0] for m in out), len(self.tokens)]
        return [replace(m, first=ends[k], last=starts[k + 1]) for k, m in enumerate(out)]

    def around(self, m: Mention, before: int = BEFORE, after: int = AFTER) -> tuple[list[str], list[str]]:
        """Words before and after a period that are about it: within so many characters, its neighbours and its sentence."""
        a, b = m.at
        low, high = self.tokens[a].start - before, self.tokens[b - 1].stop + after
        i = a
        while i > m.first and self.tokens[i - 1].start >= low and self.word(i - 1) not in _STOP:
            i -= 1
        j = b
        while j < m.last and self.tokens[j].stop <= high and self.word(j) not in _STOP:
            j += 1
        return [t.word for t in self.tokens[i:a]], [t.word for t in self.tokens[b:j]]


def _last(words: list[str], phrases) -> int:
    """Where the last of the phrases in words ends, 0 for none."""
    return max((i + len(p) for p in phrases for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p), default=0)


def _first(words: list[str], phrases) -> int | None:
    return min((i for p in phrases for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p), default=None)


def _without(words: list[str], phrases) -> list[str]:
    out, i = [], 0
    ordered = sorted(phrases, key=len, reverse=True)
    while i < len(words):
        held = next((p for p in ordered if words[i : i + len(p)] == p), None)
        out += [] if held else [words[i]]
        i += len(held) if held else 1
    return out


def counts_back(r: Reader, m: Mention) -> bool:
    """Whether the period is counted back from an event."""
    return _first(r.around(m)[1], AFTER_EVENT) is not None


def strict(r: Reader, m: Mention, phrases) -> bool:
    """Whether a bare comparative opens the period: "less than", but not "not less than"."""
    before = r.around(m)[0]
    before = before[:-1] if before[-1:] == ["("] else before
    return _last(_without(before, FLOORS + CEILINGS), phrases) > 0 and _last(before, phrases) == len(before)


def stated_operator(r: Reader, m: Mention) -> str | None:
    """min, max or exact: the nearest comparison beside the period, or None."""
    before, after = r.around(m)
    if m.last < len(r.tokens):  # what opens the next period does not close this one
        opening = max(_last(after, FLOORS), _last(after, CEILINGS))
        if opening and opening == len(after):
            after = after[: max(k for k in (_first(after, FLOORS), _first(after, CEILINGS)) if k is not None)]
    if _last(before, EXACTLY):
        return "exact"
    if strict(r, m, STRICTLY_BELOW):
        return "max"
    found = []
    floor, ceiling = _last(before, FLOORS), _last(before, CEILINGS)
    if ceiling and before[ceiling - 2 : ceiling] == ["later", "than"] and counts_back(r, m):
        floor, ceiling = max(floor, ceiling), 0
    # "not more than" holds "more than": the phrase that began earlier counts
    if ceiling and ceiling >= floor:
        found.append((len(before) - ceiling, "max"))
    elif floor:
        found.append((len(before) - floor, "min"))
    for phrases, op in ((CLOSING_FLOORS, "min"), (CLOSING_CEILINGS, "max")):
        at = _first(after, phrases)
        if at is not None and at <= 3:
            found.append((at, op))
    return min(found)[1] if found else None


def denied(r: Reader, m: Mention, after: bool = True, reach: int | None = None) -> str | None:
    """The word that denies the period, comparisons that carry one set aside; "without" only right before it."""
    before, behind = r.around(m, *((reach, reach) if reach else ()))
    phrases = FLOORS + CEILINGS
    before, behind = _without(before, phrases), _without(behind, phrases)
    near = [w for w in before if w in NEGATIONS and w != "without"]
    if near:
        return near[-1]
    close = _without(before, (["the"], ["a"], ["any"], ["giving"], ["providing"]))
    if close and close[-1] == "without":
        return "without"
    return next((w for w in behind if w in NEGATIONS and w != "without"), None) if after else None


def no_notice(r: Reader) -> bool:
    """Whether the text says that the notice is none."""
    return _last([t.word for t in r.tokens], NO_NOTICE) > 0


@lru_cache(maxsize=4096)
def mentions_of(text: str) -> tuple[Reader, tuple[Mention, ...]]:
    r = Reader(text)
    return r, tuple(r.mentions())


# ---------------------------------------------------------------- guidance


@dataclass(frozen=True)
class Rule:
    """A bound that guidance states: operator min, max or exact; a range has its ceiling too."""

    operator: str
    value: Decimal
    unit: str
    ceiling: tuple[Decimal, str] | None = None
    others: tuple["Rule", ...] = ()


def sentences_with_periods(r: Reader, found: Iterable[Mention]) -> list[tuple[str, list[Mention]]]:
    """Each sentence that states a period, with its periods."""
    breaks = [0, *(i + 1 for i, t in enumerate(r.tokens) if t.word in _STOP and (i + 1 == len(r.tokens) or r.tokens[i + 1].start > t.stop)), len(r.tokens)]
    out = []
    for a, b in zip(breaks, breaks[1:]):
        inside = [m for m in found if a <= m.at[0] < b]
        if inside:
            out.append((r.text[r.tokens[a].start : r.tokens[b - 1].stop], inside))
    return out


def _comparison(r: Reader, m: Mention) -> tuple[str | None, bool]:
    """(operator, whether what stands beside the period is understood)."""
    if strict(r, m, STRICTLY_BELOW + STRICTLY_ABOVE):
        return None, False
    stated = stated_operator(r, m)
    if stated:
        return stated, denied(r, m, after=False) is None
    before, after = r.around(m)
    return None, denied(r, m) is None and not any(w in COMPARING for w in before[-3:] + after[:3])


def rule_of(r: Reader, inside: list[Mention]) -> Rule | None:
    """The rule a sentence states; None where any of its periods is not understood: a rule is read whole or not at all.

    A period alone is a floor. Range ends are floor and ceiling; a bare period takes the comparison stated before it;
    several bare ones are no rule. One floor and one ceiling are a range, if they are in order; more of one kind are
    alternatives; more of both are no rule.
    """
    if any(m.ambiguous for m in inside):
        return None
    read, carried = [], None
    for m in inside:
        operator, understood = _comparison(r, m)
        if not understood:
            return None
        carried = operator or carried
        operator = operator or {"low": "min", "high": "max"}.get(m.end or "") or carried or ("min" if len(inside) == 1 else None)
        if operator is None:
            return None
        read.append(Rule(operator, m.readings[0], m.unit))
    floors, ceilings = ([x for x in read if x.operator == op] for op in ("min", "max"))
    if len(read) == 2 and len(floors) == len(ceilings) == 1:
        low, high = floors[0], ceilings[0]
        if low.unit == high.unit and low.value > high.value:
            return None
        return replace(low, ceiling=(high.value, high.unit))
    if floors and ceilings:
        return None
    return replace(read[0], others=tuple(read[1:]))


def choose_rule(guidance: str | None, topic: str | None) -> tuple[Rule | None, bool]:
    """(rule, whether any sentence states a period): that of the sentence that is most about the topic, the first on a tie.

    A sentence scores two for each word of the topic, and one if it speaks of notice or of ending. If the sentence chosen is not
    understood there is no rule: another sentence's is none of this topic.
    """
    if not guidance:
        return None, False
    r, found = mentions_of(guidance)
    wanted = set(re.findall(r"[a-z]{4,}", (topic or "").lower()))
    scored = [(2 * sum(w in s.lower() for w in wanted) + any(stem in s.lower() for stem in NOTICE_STEMS), inside) for s, inside in sentences_with_periods(r, found)]
    if not scored:
        return None, False
    best = max(score for score, _ in scored)
    return rule_of(r, next(inside for score, inside in scored if score == best)), True


# ---------------------------------------------------------------- calendar


@lru_cache(maxsize=2048)
def month_days(months: int) -> tuple[int, int]:
    """Fewest and most days of so many months from any day of 2072 to 2127; an end beyond its month is the month's last day."""
    start = np.arange("2072-01-01", "2128-01-01", dtype="datetime64[D]")
    month = start.astype("datetime64[M]")
    day = (start - month.astype("datetime64[D]")).astype(int)
    to = month + months
    most = ((to + 1).astype("datetime64[D]") - to.astype("datetime64[D]")).astype(int) - 1
    n = (to.astype("datetime64[D]") + np.minimum(day, most) - start).astype(int)
    return int(n.min()), int(n.max())


def calendar_days(value: Decimal, unit: str, week: int | None) -> tuple[Decimal, Decimal | None] | None:
    """(fewest, most or None) calendar days of a period; None where nothing is known."""
    if unit == "day":
        return value, value
    if unit == "week":
        return 7 * value, 7 * value
    if unit in ("month", "year"):
        months = value * (12 if unit == "year" else 1)
        if months != int(months) or months > 12_000:
            return None
        low, high = month_days(int(months))
        return Decimal(low), Decimal(high)
    n = int(value) + (value != int(value))
    days = week or 7
    return Decimal(n + (7 - days) * ((n - 1) // days) if n else 0), None if n else Decimal(0)


def _meets(operator: str, a: tuple[Decimal, str], b: tuple[Decimal, str], week: int | None) -> bool | None:
    """Whether period a meets bound b on every calendar; None where calendars differ."""
    if a[1] == b[1]:
        return a[0] >= b[0] if operator == "min" else a[0] <= b[0] if operator == "max" else a[0] == b[0]
    x, y = calendar_days(*a, week), calendar_days(*b, week)
    if x is None or y is None:
        return None
    (alo, ahi), (blo, bhi) = x, y
    if operator == "min":
        return True if bhi is not None and alo >= bhi else False if ahi is not None and ahi < blo else None
    if operator == "max":
        return True if ahi is not None and ahi <= blo else False if bhi is not None and alo > bhi else None
    return True if alo == ahi == blo == bhi else False if ahi is not None and ahi < blo or bhi is not None and alo > bhi else None


def verdict(text: str | None, rule: Rule | None, stated: bool, week: int | None = None) -> tuple[str, str]:
    """(outcome, why) of a contract sentence against a rule: pass, needs_review, ambiguous or incomparable."""
    if rule is None:
        return "incomparable", "rule not read" if stated else "no rule"
    r, found = mentions_of(text or "")
    if not found:
        if not no_notice(r):
            return "incomparable", "no period"
        values = [(Decimal(0), "day")]
    else:
        m = found[0]
        if m.ambiguous:
            return "ambiguous", "words and figures differ"
        if word := denied(r, m, reach=DENIAL):
            return "needs_review", f"denied: {word}"
        values = [(m.readings[0], m.unit)]
    bounds = [(rule.operator, (rule.value, rule.unit))] + ([("max", rule.ceiling)] if rule.ceiling else [])
    held = [_meets(op, v, b, week) for v in values for op, b in bounds]
    if rule.others and not all(held):
        return "needs_review", "alternatives"
    if False in held:
        return "needs_review", "outside"
    return ("incomparable", "calendars differ") if None in held else ("pass", "inside")


# ---------------------------------------------------------------- business weeks

_DEFINES = re.compile(r"[\"“”']?\b(?:business|working)\s+days?\b[\"“”']?\s+(?:means?|is|are|shall mean)\b[^.;]*", re.IGNORECASE)


def week_of(definition: str) -> int | None:
    """How many days of a week a definition of a business day leaves; None where it does not say."""
    words = [t.word[:-1] if t.word.endswith("s") and t.word not in ("is", "means") else t.word for t in tokens_of(definition)]
    if "including" in words or "include" in words or "includes" in words:
        return None
    days = [(i, WEEKDAYS.index(w)) for i, w in enumerate(words) if w in WEEKDAYS]
    cut = next((i for i, w in enumerate(words) if w in ("excluding", "except", "excepting", "not") or w == "other" and words[i + 1 : i + 2] == ["than"]), len(words))
    kept = [(i, d) for i, d in days if i < cut]
    if len(kept) == 2 and words[kept[0][0] + 1 : kept[1][0]] in (["to"], ["through"], ["-"], ["until"]):
        return (kept[1][1] - kept[0][1]) % 7 + 1
    if len({d for _, d in kept}) >= 2:
        return len({d for _, d in kept})
    out = {d for i, d in days if i > cut} | ({5, 6} if "weekend" in words[cut:] else set())
    return 5 if out == {5, 6} else 6 if out == {6} else None


def weeks_in(text: str | None) -> list[int | None]:
    """What each definition of a business day in the text says of its week."""
    return [week_of(m[0]) for m in _DEFINES.finditer(text or "")]
