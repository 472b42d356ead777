"""Statements in a section by which text is replaced or parts are ranked, read without looking at other sections."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from .typed_values import ValueReader, values_in

# The words of change, ranking, limits, starts, parts and times.
CHANGED = frozenset("deleted replaced superseded substituted restated".split())
CHANGES = frozenset("delete deletes deleting replace replaces replacing supersede supersedes superseding".split())
BE = frozenset("is are be hereby was were being".split())
CLAUSE_WORDS = frozenset("section sections clause clauses article articles paragraph paragraphs §".split())
RANKING = (["prevail"], ["prevails"], ["takes", "precedence"], ["take", "precedence"], ["order", "of", "precedence"], ["shall", "control"], ["governs"])
CONFLICT = frozenset("conflict conflicts inconsistency inconsistent discrepancy precedence contradiction".split())
LIMITS = tuple(p.split() for p in ("only for", "only in respect of", "only with respect to", "only to the extent", "only as it applies to", "solely for", "solely in respect of", "in respect of", "with respect to", "to the extent", "insofar as", "until"))
STARTS = tuple(p.split() for p in ("with effect from", "with effect on", "with effect as of", "effective from", "effective on", "effective as of", "effective"))
ORIGINAL = tuple(p.split() for p in ("originally", "initially", "as signed", "as first signed", "as executed", "before the amendment", "before any amendment", "prior to the amendment", "original agreement", "original contract", "original wording", "original terms"))
NOW = tuple(p.split() for p in ("now", "currently", "today", "as amended", "at present", "as it stands"))
RELATIVE = tuple(p.split() for p in ("last year", "last month", "next year", "next month", "yesterday", "tomorrow"))
ATTACHED = ("schedule", "annex", "exhibit", "appendix")
BODY = frozenset(("agreement", "general terms", "terms", "main agreement", "body", "terms and conditions", "master agreement"))

_QUOTED = re.compile(r"[“\"][^“”\"]*[”\"]")
_DEFINES = re.compile(r"[“\"]([^“”\"]{1,60})[”\"]\s+(?:(?:shall|now|hereby)\s+){0,2}(?:means?|refers?\s+to|has\s+the\s+meaning)\b", re.IGNORECASE)
_PART = re.compile(r"\b(?:(?:this|the|these)\s+)?(?:Agreement|Amendments?|Order Forms?|General Terms|Terms|Schedules?(?: [A-Z0-9]{1,3}\b)?|Annex(?:es)?(?: [A-Z0-9]{1,3}\b)?|Exhibits?(?: [A-Z0-9]{1,3}\b)?)", re.MULTILINE)


@dataclass(frozen=True)
class Statement:
    kind: str  # replaces, defines or precedence
    start: int
    stop: int
    target: str | None = None  # the clause named, or the term defined
    wording: tuple[int, int] | None = None  # the new text it quotes
    scope: str | None = None  # limits, as written
    starts: tuple[str, ...] = ()  # ISO dates from which it holds
    unread: bool = False  # a start that names no date
    parts: tuple[str, ...] = ()  # parts ranked, in order


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentences; what stands in quotation marks never ends one by itself."""
    quoted = [m.span() for m in _QUOTED.finditer(text)]
    out, begin, q = [], 0, 0
    for m in re.finditer(r"[.;!?](?=\s|$|[”\"])|\n", text):
        while q < len(quoted) and quoted[q][1] <= m.start():
            q += 1
        inside = q < len(quoted) and quoted[q][0] < m.start() < quoted[q][1]
        if inside and not (m.end() == quoted[q][1] - 1 and re.match(r"\s+[A-Z“\"]|\s*$", text[quoted[q][1] :])):
            continue
        end = quoted[q][1] if inside else m.end()
        if text[begin:end].strip():
            out.append((begin + len(text[begin:end]) - len(text[begin:end].lstrip()), end))
        begin = end
    if text[begin:].strip():
        out.append((begin + len(text[begin:]) - len(text[begin:].lstrip()), len(text)))
    return out


def _at(words: list[str], phrases, start: int = 0) -> list[tuple[int, int]]:
    """(place, length) of the phrases in words, longest first, none over another."""
    out, i = [], start
    ordered = sorted(phrases, key=len, reverse=True)
    while i < len(words):
        p = next((p for p in ordered if words[i : i + len(p)] == p), None)
        if p:
            out.append((i, len(p)))
        i += len(p) if p else 1
    return out


def _iso(key: str) -> str:
    return key[2:] if key.count("-") == 2 else key[2:] + "-01"


def statements_in(text: str | None) -> list[Statement]:
    """Replacements, fresh definitions and precedences in order of place."""
    return list(_statements(text)) if text else []


@lru_cache(maxsize=2048)
def _statements(text: str) -> tuple[Statement, ...]:
    out = []
    for start, stop in sentence_spans(text):
        found = _replacement(text, start, stop) or _definition(text, start, stop) or _precedence(text, start, stop)
        if found:
            out.append(found)
    return tuple(out)


def _replacement(text: str, start: int, stop: int) -> Statement | None:
    sentence = text[start:stop]
    quoted = [m.span() for m in _QUOTED.finditer(sentence)]
    outside = sentence
    for a, b in quoted:
        outside = outside[:a] + " " * (b - a) + outside[b:]
    r = ValueReader(outside)
    words = [t.word for t in r.tokens]
    named = [k for k, w in enumerate(words[:-1]) if w in CLAUSE_WORDS and words[k + 1][0].isdigit()]
    verb = next((k for k, w in enumerate(words) if w in CHANGED and any(x in BE for x in words[max(0, k - 3) : k]) and any(n < k for n in named)), None)
    if verb is not None:
        clause = [n for n in named if n < verb][-1]
    else:
        verb = next((k for k, w in enumerate(words) if w in CHANGES and any(k < n <= k + 3 for n in named)), None)
        if verb is None:
            return None
        clause = next(n for n in named if n > verb)
    target = words[clause + 1]
    wording = next(((start + a + 1, start + b - 1) for a, b in quoted if a >= r.tokens[verb].stop), None)
    scope, begins, unread = _limits(r, words)
    return Statement("replaces", start, stop, target, wording, scope, begins, unread)


def _limits(r: ValueReader, words: list[str]) -> tuple[str | None, tuple[str, ...], bool]:
    """(limits as written, starts as ISO dates, whether a start names no date) of a sentence's tokens."""
    limits = []
    for k, _ in _at(words, LIMITS):
        end = next((j for j in range(k, len(words)) if words[j] in (",", ";", ":") or words[j] == "." and j + 1 == len(words)), len(words))
        limits.append(r.text[r.tokens[k].start : r.tokens[end - 1].stop])
    begins, unread = [], False
    for k, n in _at(words, STARTS):
        if k + n < len(words):
            rest = r.text[r.tokens[k + n].start : r.tokens[k + n].start + 60]
            dates = [v for v in values_in(rest) if v.kind == "date" and v.start == 0]
            begins += [_iso(dates[0].key)] if dates else []
            unread |= not dates
    return "; ".join(limits) or None, tuple(begins), unread


def _definition(text: str, start: int, stop: int) -> Statement | None:
    m = _DEFINES.search(text, start, stop)
    if not m:
        return None
    r = ValueReader(text[start : m.start()])
    scope, begins, unread = _limits(r, [t.word for t in r.tokens])
    return Statement("defines", start, stop, m[1], (m.start(), stop), scope, begins, unread)


def _precedence(text: str, start: int, stop: int) -> Statement | None:
    sentence = text[start:stop]
    words = [t.word for t in ValueReader(sentence).tokens]
    if not _at(words, RANKING) or not CONFLICT & set(words):
        return None
    parts = tuple(dict.fromkeys(" ".join(m[0].split()) for m in _PART.finditer(sentence)))
    return Statement("precedence", start, stop, parts=parts) if len(parts) > 1 else None


def part_of_heading(heading: str | None) -> str | None:
    """The part that a heading opens: amendment, order form, "schedule a" ...; None for any other."""
    words = [t.word for t in ValueReader(heading or "").tokens]
    if words[:1] and words[0] in ("amendment", "addendum") or words[:3] == ["first", "amendment", "agreement"]:
        return "amendment"
    if words[:2] == ["order", "form"]:
        return "order form"
    if len(words) > 1 and words[0] in ATTACHED and len(words[1]) <= 3:
        return f"{words[0]} {words[1]}"
    return None


def ranked_part(named: str) -> tuple[str, ...]:
    """The parts that a ranked name stands for: itself, or every one of a kind ("schedule *")."""
    key = " ".join(w for w in named.lower().split() if w not in ("this", "the", "these"))
    if key in BODY:
        return ("body",)
    if key.startswith("amendment"):
        return ("amendment",)
    if key in ("schedules", "annexes", "exhibits", "appendices"):
        return ({"schedules": "schedule", "annexes": "annex", "exhibits": "exhibit", "appendices": "appendix"}[key] + " *",)
    return (key[:-1] if key == "order forms" else key,)


def perspective(question: str | None) -> str:
    """historical, dated, current or unstated: which wording a question asks about."""
    r = ValueReader(question or "")
    words = [t.word for t in r.tokens]
    if _at(words, ORIGINAL):
        return "historical"
    year = any(w in ("in", "during", "since", "before", "after", "until", "throughout") and re.fullmatch(r"(?:19|20)\d\d", x) for w, x in zip(words, words[1:]))
    if year or _at(words, RELATIVE) or any(v.kind == "date" for v in r.values()):
        return "dated"
    return "current" if _at(words, NOW) else "unstated"


