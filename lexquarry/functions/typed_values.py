"""Values that a text states, with kinds and canonical keys: dates, percentages, money, durations, plain numbers.

One pass over a text's tokens. A value's key is its number (`n:45`) or date (`d:2027-12-27`, `d:2027-12`); its kind is date,
percent, money, clock, days, months (the unit families between which nothing is converted) or plain; its base key is the
value in its family's base unit (`months:12` for one year). Numbers that point ("Section 4.2", "Amendment No. 1"), that are
glued to letters, grouped wrongly or too long, and dates that could be read either way round state nothing.

Null and empty texts state nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache

from .period_grammar import POINTING, Reader

# Months, currencies, magnitudes, and unit families with their base units.
MONTHS = "january february march april may june july august september october november december".split()
MARKS = {"$": "$", "€": "€", "£": "£", "¥": "¥"}
CODES = frozenset("usd eur gbp chf cad aud".split())
MONEY_WORDS = frozenset("dollar dollars euro euros pound pounds".split())
MAGNITUDES = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
SUFFIXES = {"k": 3, "m": 6, "mm": 6, "b": 9, "bn": 9}
FAMILIES = {
    "second": ("clock", 1), "minute": ("clock", 60), "hour": ("clock", 3600), "day": ("days", 1), "week": ("days", 7), "fortnight": ("days", 14),
    "month": ("months", 1), "year": ("months", 12),
}
NAMED_BY_NUMBER = frozenset("amendment amendments supplement order orders contract agreement invoice lease licence license policy account schedule".split())
PARTIES = frozenset("party parties side sides".split())
MOST_DIGITS = 24
SHOWN = 8


@dataclass(frozen=True)
class Value:
    start: int
    stop: int
    surface: str
    key: str
    kind: str
    base: str | None


def _plain(value: Decimal) -> str:
    text = f"{value:f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


_MONTH = {name: k for k, m in reversed(list(enumerate(MONTHS, 1))) for name in (m, m[:3], m[:4])}


def _month(word: str) -> int | None:
    return _MONTH.get(word)


class ValueReader(Reader):
    """The automaton over one text's tokens; words alone count as numbers only before a unit in an answer."""

    def _glued(self, i: int) -> bool:
        """Whether token i starts where token i-1 ends."""
        return 0 < i < len(self.tokens) and self.tokens[i - 1].stop == self.tokens[i].start

    def _date(self, i: int) -> tuple[str | None, int] | None:
        """(key or None, token after) of a date at token i."""
        w, t = self.word, self.tokens
        if t[i].word.isdigit() and w(i + 1) in ("-", "/") and w(i + 3) == w(i + 1) and w(i + 2).isdigit() and w(i + 4).isdigit() and all(self._glued(j) for j in range(i + 1, i + 5)):
            a, b, c = t[i].word, int(w(i + 2)), w(i + 4)
            key = None
            if len(a) == 4 and len(c) <= 2 and 1 <= b <= 12 and 1 <= int(c) <= 31:
                key = f"d:{a}-{b:02d}-{int(c):02d}"
            elif len(c) == 4 and len(a) <= 2:
                if 12 < int(a) <= 31 and 1 <= b <= 12:
                    key = f"d:{c}-{b:02d}-{int(a):02d}"
                elif 1 <= int(a) <= 12 and (12 < b <= 31 or int(a) == b):
                    key = f"d:{c}-{int(a):02d}-{b:02d}"
            return key, i + 5
        year = lambda j: w(j) if len(w(j)) == 4 and w(j).isdigit() and not (self._glued(j + 1) and w(j + 1)[0].isalnum()) else None
        comma = lambda j: j + 1 if w(j) == "," else j
        if (m := _month(w(i))) is not None:
            if w(i + 1).isdigit() and len(w(i + 1)) <= 2:
                j = i + 3 if w(i + 2) in ("st", "nd", "rd", "th") else i + 2
                if y := year(comma(j)):
                    return f"d:{y}-{m:02d}-{int(w(i + 1)):02d}", comma(j) + 1
            if y := year(comma(i + 1)):
                return f"d:{y}-{m:02d}", comma(i + 1) + 1
        if t[i].word.isdigit() and len(t[i].word) <= 2:
            j = i + 2 if w(i + 1) in ("st", "nd", "rd", "th") else i + 1
            j = j + 2 if w(j) == "day" and w(j + 1) == "of" else j
            if (m := _month(w(j))) is not None and (y := year(comma(j + 1))):
                return f"d:{y}-{m:02d}-{int(t[i].word):02d}", comma(j + 1) + 1
        return None

    def _figures(self, i: int) -> tuple[Decimal | None, int] | None:
        """(number or None if it is set aside, token after) of digits at token i."""
        if self.tokens[i].number is None:
            return None
        j, whole = i + 1, True
        while self._glued(j) and (self.word(j)[0].isdigit() or self.word(j) in (",", ".") and self._glued(j + 1) and self.word(j + 1)[0].isdigit()):
            j, whole = j + 1, False  # "1,5" and "1.2.3" are no number
        digits = self.tokens[i].word.replace(",", "")
        return (Decimal(digits) if whole and len(digits) <= MOST_DIGITS else None), j

    def _pointer(self, i: int) -> int | None:
        """The token after what only points at a provision or names an instrument, from its word on."""
        w = self.word
        j = i + 1
        if w(i) in NAMED_BY_NUMBER and (w(j) == "#" or w(j) == "no" and w(j + 1) == "."):
            j += 1 if w(j) == "#" else 2
        elif w(i) in POINTING and w(i) not in ("no", "nos", "number", "$", "€", "£", "¥", "#"):
            j += 2 if w(j) in ("no", "nos") and w(j + 1) == "." else w(j) == "number"
        else:
            return None
        if not (w(j)[:1].isdigit()):
            return None
        while True:
            j = self._figures(j)[1]
            while w(j) == "(" and self._glued(j) and w(j + 2) == ")":
                j += 3
            k = j + (w(j) in (",", "and", "or", "to", "&")) if w(j) in (",", "and", "or", "to", "&") else j
            k += w(k) in ("and", "or") and k > j
            listed = w(i).endswith("s") or w(i) == "§"
            if k == j or not listed or not w(k)[:1].isdigit() or self._unit_kind(self._figures(k)[1])[0] != "plain":
                return j
            j = k

    def _unit_kind(self, j: int) -> tuple[str, int, int]:
        """(kind, factor, token after) of what stands after a number."""
        w = self.word
        k = j + 1 if w(j) == "-" else j
        k = k + 1 if w(k) in ("calendar", "business", "working") else k
        name = w(k)[:-1] if w(k).endswith("s") else w(k)
        if name in FAMILIES:
            return (*FAMILIES[name], k + 1)
        if w(j) == "%" or w(j) == "percent":
            return "percent", 1, j + 1
        if w(j) == "per" and w(j + 1) == "cent":
            return "percent", 1, j + 2
        if w(j) in MONEY_WORDS or w(j) in CODES or w(j) in MARKS:
            return "money", 1, j + 1
        return "plain", 1, j

    def values(self, answer: bool = False) -> list[Value]:
        out: list[Value] = []
        self.made: list[tuple[int | None, int, int]] = []  # of each value: its figures' token, if any, what they are scaled and multiplied by
        i = 0
        while i < len(self.tokens):
            if answer and (j := self._pointer(i)):
                i = j
                continue
            if found := self._date(i):
                key, j = found
                if key:
                    out.append(self._value(i, j, key, "date", None))
                    self.made.append((None, 0, 1))
                i = j
                continue
            money = self.word(i) in MARKS or self.word(i) in CODES
            at = i + 1 if money and i + 1 < len(self.tokens) and self.tokens[i + 1].number is not None else i
            number, j, spelled, power = None, at, False, 0
            if figures := self._figures(at):
                number, j = figures
            elif words := self.in_words(at):
                number, j, spelled = Decimal(words[0]), words[1], True
            if j == at:
                i += 1
                continue
            if figures and self._glued(at) and self.tokens[at - 1].word[-1].isalpha() and at == i:
                i = j
                continue
            if figures and self._glued(j) and self.word(j)[0].isalpha():  # "$1.5M" is read whole, "100m" set aside
                scale = SUFFIXES.get(self.word(j)) if at > i else None
                number, j, power = (number * 10**scale if number is not None and scale else None), j + 1, scale or 0
            elif self.word(j) in MAGNITUDES and number is not None:
                power = MAGNITUDES[self.word(j)]
                number, j = number * 10**power, j + 1
            if number is None:
                i = j
                continue
            restated = self._restated(j, number)
            kind, factor, end = self._unit_kind(restated or j)
            if at > i:
                kind, factor, end = "money", 1, j
            elif kind == "plain":
                end = j
            if not (spelled and answer and kind == "plain"):
                base = None if kind == "plain" else f"{kind}:{_plain(number * factor)}"
                out.append(self._value(i, end, f"n:{_plain(number)}", kind, base))
                self.made.append((at if figures else None, power, factor))
            i = max(end, j, restated or 0)
        return out

    def _restated(self, j: int, number: Decimal) -> int | None:
        """The token after a restatement of the number in brackets."""
        if self.word(j) != "(":
            return None
        inner = self._figures(j + 1) if j + 1 < len(self.tokens) else None
        words = self.in_words(j + 1)
        value, k = inner if inner else (Decimal(words[0]), words[1]) if words else (None, j)
        return k + 1 if value == number and self.word(k) == ")" else None

    def _value(self, i: int, j: int, key: str, kind: str, base: str | None) -> Value:
        start, stop = self.tokens[i].start, self.tokens[j - 1].stop
        surface = self.text[start:stop]
        if self.places is not None:
            start, stop = self.places[start], self.places[stop - 1] + 1
        return Value(start, stop, surface, key, kind, base)


# ---------------------------------------------------------------- texts that differ in their figures only

#: Where a text may be cut: no reading passes a full stop before white space, but for "No. 1".
_CUT = re.compile(r"\.(?<!\s\.)(?<![nN][oO]\.)(?<![nN][oO][sS]\.)\s+")
_RUN = re.compile(r"[0-9]+")
_FORMS: dict[tuple, tuple] = {}
MOST_FORMS = 20_000


@lru_cache(maxsize=16_384)
def _size(run: str) -> str:
    """All that the automaton asks of a run of digits by itself: its length, and whether it can be a month or a day."""
    v = run.lstrip("0")
    return f"<{len(run)}{'h' if len(v) > 2 else 'z' if not v else 'm' if int(v) <= 12 else 'd' if int(v) <= 31 else 'h'}>"


def _form(piece: str, answer: bool) -> tuple:
    """What tells a piece from others apart from the figures themselves; dates also ask whether day and month are equal."""
    form = (_RUN.sub(lambda m: _size(m[0]), piece), answer)
    if "/" in piece or "-" in piece:
        runs = [x.lstrip("0") for x in _RUN.findall(piece)]
        form += (tuple(map(str.__eq__, runs, runs[1:])),)
    return form


def _recipes(piece: str, answer: bool) -> tuple[tuple, ...]:
    """(start, stop, kind, what makes the key) of each value of a piece: constants, places of a date's figures or of a number."""
    r = ValueReader(piece)
    out = []
    for v, (token, power, factor) in zip(r.values(answer), r.made):
        if v.kind == "date":
            runs = [(v.start + m.start(), v.start + m.end()) for m in _RUN.finditer(v.surface)]
            month = v.key.split("-")[1]
            if len(runs) == 3:  # year first; else the one that can be no month is the day
                order = (0, 1, 2) if runs[0][1] - runs[0][0] == 4 else (2, 1, 0) if int(piece[slice(*runs[0])]) > 12 else (2, 0, 1)
                made = ("d", runs[order[0]], runs[order[1]], runs[order[2]])
            else:
                made = ("d", runs[-1], month, runs[0] if len(runs) == 2 else None)
        elif token is None:
            made = ("c", v.key, v.base)
        else:
            t = r.tokens[token]
            made = ("n", t.start, t.stop, power, factor)
        out.append((v.start, v.stop, v.kind, made))
    return tuple(out)


def _made(piece: str, kind: str, made: tuple) -> tuple[str, str | None]:
    """(key, base) of a value by its recipe."""
    if made[0] == "c":
        return made[1], made[2]
    if made[0] == "d":
        _, year, month, day = made
        y, m = piece[slice(*year)], month if isinstance(month, str) else f"{int(piece[slice(*month)]):02d}"
        return (f"d:{y}-{m}" if day is None else f"d:{y}-{m}-{int(piece[slice(*day)]):02d}"), None
    _, a, b, power, factor = made
    figures = piece[a:b].replace(",", "")
    if not power and figures.isdigit():
        number = figures.lstrip("0") or "0"
        base = number if factor == 1 else str(int(number) * factor)
    else:
        value = Decimal(figures) * 10**power
        number, base = _plain(value), _plain(value * factor)
    return f"n:{number}", None if kind == "plain" else f"{kind}:{base}"


@lru_cache(maxsize=4096)
def _read_piece(piece: str, answer: bool) -> tuple[tuple, ...]:
    return tuple((v.start, v.stop, v.surface, v.key, v.kind, v.base) for v in ValueReader(piece).values(answer))


def rows_in(text: str, answer: bool = False) -> list[tuple[int, int, str, str, str, str | None]]:
    """(start, stop, surface, key, kind, base) of the values of a text in order.

    A plain text is read piece by piece, and pieces of one form by the automaton once: from then on the figures are put in
    their places. Numbers restated in brackets must be equal, so such pieces are read as they are.
    """
    if not text.isascii():
        return list(_read_piece(text, answer))
    out, begin, pieces = [], 0, []
    for m in _CUT.finditer(text):
        pieces.append((begin, text[begin : m.start() + 1]))
        begin = m.end()
    pieces.append((begin, text[begin:]))
    for at, piece in pieces:
        if "(" in piece:
            out += [(a + at, b + at, *rest) for a, b, *rest in _read_piece(piece, answer)]
            continue
        form = _form(piece, answer)
        recipes = _FORMS.get(form)
        if recipes is None:
            if len(_FORMS) >= MOST_FORMS:
                _FORMS.clear()
            recipes = _FORMS[form] = _recipes(piece, answer)
        for a, b, kind, made in recipes:
            key, base = _made(piece, kind, made)
            out.append((a + at, b + at, piece[a:b], key, kind, base))
    return out


@lru_cache(maxsize=4096)
def values_in(text: str, answer: bool = False) -> tuple[Value, ...]:
    """The values of a text in order; of an answer, without what only points."""
    return tuple(Value(*row) for row in rows_in(text, answer))


def statements(text: str) -> list[str]:
    """Sentences, and clauses parted by a semicolon."""
    return [s for s in re.split(r"(?<=[.;!?])\s+", text) if s]


def every_party(statement: str) -> bool:
    """Whether the statement's subject takes in every party: each party, both sides, the parties, both A and B."""
    r = Reader(statement)
    words = [t.word for t in r.tokens]
    for i, w in enumerate(words):
        if w == "parties" and words[i - 1 : i] == ["the"]:
            return True
        if w in ("each", "either", "both", "every", "all", "neither"):
            rest = [x for x in words[i + 1 : i + 5] if x not in ("of", "the", "two")]
            if rest[:1] and rest[0] in PARTIES:
                return True
            named = [t for t in r.tokens[i + 1 : i + 6] if t.word != "the"]
            if w == "both" and len(named) >= 3 and named[1].word == "and" and all(r.text[t.start].isupper() for t in (named[0], named[2])):
                return True
    return False


def choices(answer: str, offered: dict[str, dict[str, str]], aside: frozenset[str] = frozenset()) -> list[tuple[str, str, str, int, frozenset[str]]]:
    """(kind, values used, values offered, how many more, base keys used) for each kind of which the answer uses some of
    several values offered and not all; at most SHOWN are named."""
    used: dict[str, dict[str, str]] = {}
    for v in values_in(answer, True):
        if v.base and v.base not in aside and v.base in offered.get(v.kind, {}):
            used.setdefault(v.kind, {}).setdefault(v.base, v.surface)
    out = []
    for kind, mine in used.items():
        there = list(offered[kind].values())
        if len(there) > 1 and len(mine) < len(there):
            out.append((kind, ", ".join(mine.values()), "; ".join(there[:SHOWN]), max(0, len(there) - SHOWN), frozenset(mine)))
    return out


def offered_values(quotes: list[str], question: str | None = None) -> dict[str, dict[str, str]]:
    """kind -> base key -> as written, in order; values that the question names are set aside."""
    asked = {v.base for v in values_in(question or "", True)} | {v.key for v in values_in(question or "", True) if v.kind == "plain"}
    out: dict[str, dict[str, str]] = {}
    for q in quotes:
        for v in values_in(q):
            if v.base and v.base not in asked and v.key not in asked:
                out.setdefault(v.kind, {}).setdefault(v.base, v.surface)
    return out


def uniform_claims(answer: str | None, quotes: list[str], question: str | None = None) -> list[tuple[str, str, str]]:
    """(kind, value, values offered) of each statement of the answer that gives every party some of the values its passages
    offer, where no statement of the passages gives that value to every party."""
    offered = offered_values(quotes, question)
    general = {v.base for q in quotes for s in statements(q) if every_party(s) for v in values_in(s)}
    return [(kind, used, there) for s in statements(answer or "") if every_party(s) for kind, used, there, _, keys in choices(s, offered) if not keys & general]
