"""Statements by which one part of a document stands over or replaces another, and what they do to a finding."""

from __future__ import annotations

import re
from typing import NamedTuple

from .links import LISTED, MENTION, STATUTES

# Words that rank parts, and that replace text.
PARTS = r"(?:this\s+)?(?:Agreement|Schedule\s+\w+|Schedules?|Amendment(?:\s+No\.\s*\d+)?|Order\s+Forms?|Exhibit\s+\w+|Annex\s+\w+|Terms)"
_PRECEDENCE = re.compile(r"\b(?:prevails?|takes?\s+precedence|shall\s+control|controls?|governs?\s+over|order\s+of\s+precedence)\b", re.IGNORECASE)
_REPLACE = re.compile(r"\b(?:is|are|shall\s+be)\s+(?:hereby\s+)?(?:deleted\s+(?:in\s+its\s+entirety\s+)?and\s+replaced|replaced|amended\s+(?:and\s+restated\s+)?to\s+read|superseded)\b", re.IGNORECASE)
_PART = re.compile(PARTS)
_DATE = re.compile(r"\b(?:effective|with\s+effect\s+from|as\s+of|from)\s+(\d{4}-\d{2}-\d{2})\b", re.IGNORECASE)
_SENTENCE = re.compile(r"[^.;!?]+[.;!?]?")
MOST = 24


def clauses(text: str) -> tuple[str, ...]:
    """Distinct clause numbers that a sentence names, those of statutes left out."""
    statute = re.compile(rf"\s+of\s+(?:the\s+)?(?:[A-Z]\S*\s+){{0,6}}(?:{'|'.join(STATUTES)})\b")
    own = [m[0] for m in re.finditer(MENTION, text) if not statute.match(text, m.end())]
    return tuple(dict.fromkeys(n for m in own for n in re.findall(LISTED, m)))


class Relation(NamedTuple):
    kind: str  # replacement or precedence
    start: int
    stop: int
    names: tuple[str, ...]  # clauses replaced, or parts from the highest to the lowest
    effective: str | None


def relations_in(text: str | None) -> list[Relation]:
    """Replacement and precedence statements in reading order; a precedence ranks two parts at least."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        s = m[0]
        date = _DATE.search(s)
        if _REPLACE.search(s) and (named := clauses(s)):
            out.append(Relation("replacement", m.start(), m.end(), named, date and date[1]))
        elif p := _PRECEDENCE.search(s):
            parts = [re.sub(r"\s+", " ", x[0]).strip() for x in _PART.finditer(s)]
            if len(parts) >= 2:
                first = [x for x in _PART.finditer(s) if x.end() <= p.start()]
                order = parts if first else parts[::-1]
                out.append(Relation("precedence", m.start(), m.end(), tuple(dict.fromkeys(order)), date and date[1]))
    return out


def nearest(relations: list[Relation], start: int, stop: int, most: int = MOST) -> list[Relation]:
    """At most `most`, those that touch the passage first, then by place."""
    return sorted(sorted(relations, key=lambda r: (not (r.start < stop and r.stop > start), r.start))[:most], key=lambda r: r.start)


def in_force(relations: list[Relation], as_of: str) -> list[Relation]:
    """Those without a date or whose date has come; of several replacements of a clause the latest that has."""
    latest: dict[str, Relation] = {}
    out = []
    for r in relations:
        if r.effective is not None and r.effective > as_of:
            continue
        if r.kind == "precedence":
            out.append(r)
            continue
        for n in r.names:
            if n not in latest or (r.effective or "") >= (latest[n].effective or ""):
                latest[n] = r
    return sorted(set(out) | set(latest.values()), key=lambda r: r.start)


def assess(clause: str, quotes: list[tuple[int, int]], relations: list[Relation], as_of: str) -> str:
    """'replaced' if a statement in force replaces the finding's clause outside its quotes, 'shown' if a quote holds the
    statement, 'pending' if its date is still to come, else 'clear'."""
    mine = [r for r in relations if r.kind == "replacement" and any(n == clause or clause.startswith(n + ".") for n in r.names)]
    held = lambda r: any(a <= r.start and b >= r.stop for a, b in quotes)
    live = [r for r in in_force(mine, as_of)]
    if any(not held(r) for r in live):
        return "replaced"
    if live:
        return "shown"
    return "pending" if mine else "clear"
