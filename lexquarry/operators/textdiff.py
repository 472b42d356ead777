"""Word and character differences, and the longest run that two texts share."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def common_items(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, the earliest in b of equal length."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of a and each prefix of b; one row of the table at a time."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        fresh = row.copy()
        fresh[1:] = np.where(b == x, row[:-1] + 1, row[1:])
        row = np.maximum.accumulate(fresh)
    return row


def _halves(a: np.ndarray, b: np.ndarray, i: int, j: int, out: list[tuple[int, int]]) -> None:
    """Pairs of a longest common subsequence of a and b, which begin at i and j, by halves of a: memory is linear."""
    stack = [(a, b, i, j)]
    while stack:
        a, b, i, j = stack.pop()
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            out.append((i + same, j + same))
            same += 1
        a, b, i, j = a[same:], b[same:], i + same, j + same
        while len(a) and len(b) and a[-1] == b[-1]:
            out.append((i + len(a) - 1, j + len(b) - 1))
            a, b = a[:-1], b[:-1]
        if len(a) > len(b):  # the shorter one is halved: rows are the longer one, read at once
            swapped: list[tuple[int, int]] = []
            if len(b) == 1:
                at = np.flatnonzero(a == b[0])
                out += [(i + int(at[0]), j)] if len(at) else []
            elif len(b):
                _halves(b, a, j, i, swapped)
                out += [(x, y) for y, x in swapped]
            continue
        if len(a) == 1:
            at = np.flatnonzero(b == a[0])
            if len(at):
                out.append((i, j + int(at[0])))
        elif len(a):
            mid = len(a) // 2
            cut = int(np.argmax(_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]))
            stack += [(a[:mid], b[:cut], i, j), (a[mid:], b[cut:], i + mid, j + cut)]


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of items that stand once in both, in the longest order that both share (patience)."""
    once_a, once_b = ({x: k for k, x in enumerate(s) if count[x] == 1} for s, count in ((a, Counter(a)), (b, Counter(b))))
    tops: list[int] = []
    piles: list[tuple[int, int, int]] = []  # (place in a, place in b, pile member before)
    last: list[int] = []
    for i, j in sorted((i, once_b[x]) for x, i in once_a.items() if x in once_b):
        at = bisect_left(tops, j)
        piles.append((i, j, last[at - 1] if at else -1))
        if at == len(tops):
            tops.append(j)
            last.append(len(piles) - 1)
        else:
            tops[at], last[at] = j, len(piles) - 1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(piles[k][:2])
        k = piles[k][2]
    return out[::-1]


def common_pairs(a: list, b: list, anchored: bool = True) -> list[tuple[int, int]]:
    """Index pairs of a common subsequence in memory linear in both: items that are unique in both are kept where their
    order allows, and between them the subsequence is a longest one; a longest one throughout without anchors."""
    numbers: dict = {}
    x, y = (np.array([numbers.setdefault(v, len(numbers)) for v in s], dtype=np.int64) for s in (a, b))
    out: list[tuple[int, int]] = []
    i = j = 0
    for p, q in [*(_anchors(a, b) if anchored else []), (len(a), len(b))]:
        _halves(x[i:p], y[j:q], i, j, out)
        if p < len(a):
            out.append((p, q))
        i, j = p + 1, q + 1
    return sorted(out)


def word_diff(old: str, new: str) -> list[tuple[str, str]]:
    """Runs of (same, removed or added, text) over words and the white space between them."""
    a, b = re.findall(r"\S+|\s+", old), re.findall(r"\S+|\s+", new)
    out: list[tuple[str, str]] = []

    def put(kind: str, text: str) -> None:
        if text:
            if out and out[-1][0] == kind:
                out[-1] = (kind, out[-1][1] + text)
            else:
                out.append((kind, text))

    i = j = 0
    for x, y in [*common_pairs(a, b), (len(a), len(b))]:
        put("removed", "".join(a[i:x]))
        put("added", "".join(b[j:y]))
        if x < len(a):
            put("same", a[x])
        i, j = x + 1, y + 1
    return out


def shared_run(quote: str, passages: list[str]) -> str:
    """The longest run of the quote's words that one passage holds."""
    words, best = quote.split(), ""
    for p in passages:
        text = " " + " ".join(p.split()) + " "
        for s in range(len(words)):
            e = s + 1
            while e <= len(words) and f" {' '.join(words[s:e])} " in text:
                e += 1
            if len(run := " ".join(words[s : e - 1])) > len(best):
                best = run
    return best


def line_changes(pairs: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """key, same, removed, added: how many lines two texts share in order and how many each has besides; null is an empty text."""
    rows = pairs.select(*key, F.col(old).alias("__old"), F.col(new).alias("__new"))
    schema = T.StructType(rows.schema.fields[: len(key)] + T.StructType.fromDDL("same bigint, removed bigint, added bigint").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(*[c.to_pylist() for c in batch.columns[len(key) :]]):
                a, b = (t.split("\n") if t else [] for t in (a, b))
                n = len(common_pairs(a, b))
                out.append((n, len(a) - n, len(b) - n))
            columns = zip(*out) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], *[pa.array(v, type=pa.int64()) for v in columns]], schema=arrow)

    return rows.mapInArrow(run, schema)
