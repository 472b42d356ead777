"""Licence scanning with one suffix automaton over all licence texts.

The templates, whole permission texts and the short lines that name a licence, are token sequences; a generalised suffix
automaton holds every run of tokens of every template. A document's tokens stream through it, slice by slice: the state
and the length that each token leaves are its matching statistics, the longest run ending there that some template holds.
Runs that the next token does not prolong are anchors, at every template place where their state ends. Anchors in the
order of both texts with short gaps are chained, so changed, missing and inserted words only leave gaps; a chain that
covers enough of its template is a span. Where spans of different labels share most of their words, the one that covers
more stays: the lesser form of a licence does not also count as the plain one.

The fixed phrases are templates as well. A phrase ends at a token if it is a suffix of the run matched there, which is
known for each state, so every place is found in the same pass.

The automaton is made once a worker from the texts below; nothing is broadcast or shuffled.

Defined results: null and empty texts have no words, no labels and score 0; equal rows give equal results; texts of any
length are read whole; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns, pruned
from .decontaminate import words_of

# Phrases with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Label and text of public licences and of the lines that name them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("bsd", "Released under the BSD License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "Released under the GNU General Public License."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software.",
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    ),
)

#: Words of the shortest anchor, words a gap between anchors may have in either text, share of a template a span covers.
LEAST, GAP, SHARE = 4, 12, 0.7
SLICE = 1 << 20


class SuffixAutomaton:
    """All runs of several token sequences: `step` gives the longest suffix read so far that one of them holds."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        for number, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                ends.append((last, number, at))
        #: Where the runs of a state end: (sequence, place) pairs, handed down the suffix links from longer runs.
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for state, number, at in ends:
            self.places[state].append((number, at))
        for state in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.places[self.link[state]] += self.places[state]
        self.places = [sorted(set(p)) for p in self.places]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _part(self, state: int, token: int, target: int) -> int:
        """The state of exactly the runs that end one token after `state`, taken out of a target that holds longer ones."""
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if (known := self.next[last].get(token)) is not None:  # an earlier sequence holds this prefix
            return self._part(last, token, known)
        made = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = made
            at = self.link[at]
        if at >= 0:
            self.link[made] = self._part(at, token, self.next[at][token])
        return made

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(token)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least: int = LEAST, gap: int = GAP, share: float = SHARE):
        self.labels = [label for label, _ in templates]
        texts = [words_of(text) for _, text in templates]
        known = [p.encode().split() for p, _ in phrases]
        self.ids = {w: k + 1 for k, w in enumerate(sorted({w for t in (*texts, *known) for w in t}))}
        sequences = [[self.ids[w] for w in t] for t in (*texts, *known)]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        self.least, self.gap, self.share = least, gap, share
        self.phrases = [label for _, label in phrases]
        #: Phrases that are a suffix of a state's longest run: (label, words).
        self.endings: list[list[tuple[str, int]]] = [[] for _ in self.automaton.places]
        for v in sorted(range(1, len(self.endings)), key=lambda v: self.automaton.length[v]):
            ended = {number - len(texts) for number, at in self.automaton.places[v] if number >= len(texts) and at == self.sizes[number] - 1}
            own = [(self.phrases[k], len(known[k])) for k in sorted(ended) if len(known[k]) <= self.automaton.length[v]]
            self.endings[v] = own + [x for x in self.endings[self.automaton.link[v]] if x not in own]

    def scan(self, slices: Iterable[list[bytes]]):
        """(words, phrase places (start, label, stop), spans, largest share) of a text given as slices of its words."""
        get, step, endings, least = self.ids.get, self.automaton.step, self.endings, self.least
        base, anchors = [], []
        total = state = length = 0
        for words in slices:
            ids = np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words))
            inside = ids > 0
            # only runs of known words can match; a run may go on from the slice before
            edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
            after = 0
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if a > after or a == 0 and not length:
                    if length >= least:
                        anchors.append((total + after, length, state))
                    state = length = 0
                for i, token in enumerate(ids[a:b].tolist(), total + a):
                    before = length, state
                    state, length = step(state, length, token)
                    if before[0] >= least and length <= before[0]:
                        anchors.append((i, *before))
                    if endings[state]:
                        base += [(i + 1 - n, label, i + 1) for label, n in endings[state] if n <= length]
                after = b
            if after < len(words):
                if length >= least:
                    anchors.append((total + after, length, state))
                state = length = 0
            total += len(words)
        if length >= least:
            anchors.append((total, length, state))
        return total, sorted(base), *self._spans(anchors)

    def _spans(self, anchors: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, str, int, float]], float]:
        """The chains that cover enough, (start, stop, label, covered words, covered share) by start, and the largest share of
        any chain; anchors: (stop, length, state)."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for stop, length, state in anchors:
            for number, at in self.automaton.places[state]:
                if number < len(self.labels):
                    by_template.setdefault(number, []).append((stop, at + 1, length))
        found, best = [], 0.0
        for number, mine in by_template.items():
            for start, stop, covered in self._chains(sorted(mine)):
                best = max(best, share := min(1.0, covered / self.sizes[number]))
                if share >= self.share:
                    found.append((start, stop, self.labels[number], covered, share))
        found.sort()
        starts, longest = [x[0] for x in found], max((x[1] - x[0] for x in found), default=0)

        def beaten(x) -> bool:
            """Whether a span of another label covers more and holds over half of this one."""
            near = found[bisect_left(starts, x[0] - longest) : bisect_left(starts, x[1])]
            return any(y[2] != x[2] and (y[3], y[4]) > (x[3], x[4]) and 2 * (min(x[1], y[1]) - max(x[0], y[0])) > x[1] - x[0] for y in near)

        return [x for x in found if not beaten(x)], best

    def _chains(self, anchors: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """(start, stop, covered words) of the best chains of one template's anchors (stop, template stop, length)."""
        longest = max(n for _, _, n in anchors)
        best, before, first = [], [], 0
        for j, (stop, at, n) in enumerate(anchors):
            top, link = n, -1
            while anchors[first][0] < stop - 2 * longest - self.gap:
                first += 1
            for k in range(first, j):
                stop_k, at_k, _ = anchors[k]
                if stop_k < stop and at_k < at and stop - n - stop_k <= self.gap and at - n - at_k <= self.gap:
                    gain = best[k] + min(n, stop - stop_k, at - at_k)
                    if gain > top:
                        top, link = gain, k
            best.append(top)
            before.append(link)
        used = [False] * len(anchors)
        for j in sorted(range(len(anchors)), key=lambda j: (-best[j], anchors[j])):
            if used[j]:
                continue
            at = j
            while True:
                used[at] = True
                if before[at] < 0 or used[before[at]]:
                    break
                at = before[at]
            covered = best[j] - (best[before[at]] if before[at] >= 0 else 0)
            yield anchors[at][0] - anchors[at][2], anchors[j][0], covered


@cache
def scanner() -> Scanner:
    return Scanner()


def word_slices(text: str | None, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice of about `size` characters; no word is cut."""
    at = 0
    while text and at < len(text):
        to = at + size
        while to < len(text) and (text[to] > "\x7f" or text[to].isalnum()):
            to += 1
        yield words_of(text[at:to])
        at = to


def scan_text(text: str | None):
    return scanner().scan(word_slices(text))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, `phrases` (start, label, stop) and `spans` (start, stop, label, covered, share)."""

    def run(ids, texts):
        found = [scan_text(t) for t in texts]
        phrases = [[{"start": s, "label": k, "stop": e} for s, k, e in base] for _, base, _, _ in found]
        spans = [[dict(zip(("start", "stop", "label", "covered", "share"), x)) for x in spans] for _, _, spans, _ in found]
        return ids, [n for n, *_ in found], phrases, spans

    kind = dict(docs.dtypes)[id_col]
    ddl = f"id {kind}, n_words bigint, phrases array<struct<start:bigint,label:string,stop:bigint>>, spans array<struct<start:bigint,stop:bigint,label:string,covered:bigint,share:double>>"
    return map_columns(pruned(docs, id=id_col, text=text_col), run, ddl)


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row a document; score: the largest share of a template that one chain covers, 1 for a whole phrase."""

    def run(ids, texts):
        out = []
        for i, t in zip(ids, texts):
            n, base, spans, best = scan_text(t)
            named = {label for _, label, _ in base}
            starts = [s for s, _, _ in base]
            labels = named | {x[2] for x in spans}
            out.append((i, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), 1.0 if base else best))
        return [list(c) for c in zip(*out)] or [[]] * 8

    ddl = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return map_columns(pruned(docs, doc_id="doc_id", text="text"), run, ddl)
