"""Licence scanning: matching statistics, phrases and chains against plain searches."""

from __future__ import annotations

import random
import re

from lexquarry.llm import licenses
from lexquarry.llm.decontaminate import words_of


def plain_phrases(text):
    words = [w.decode() for w in words_of(text)]
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label, i + len(p)) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_matching_statistics_and_places():
    rng = random.Random(3)
    for _ in range(150):
        sequences = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        automaton = licenses.SuffixAutomaton(sequences)
        runs = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        text, state, length = [rng.randrange(1, 5) for _ in range(40)], 0, 0
        for i, token in enumerate(text):
            state, length = automaton.step(state, length, token)
            assert length == max([n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs], default=0)
            if length:
                run = text[i + 1 - length : i + 1]
                assert automaton.places[state] == [(k, e) for k, s in enumerate(sequences) for e in range(len(s)) if e + 1 >= length and s[e + 1 - length : e + 1] == run]


def test_phrases_equal_a_plain_search():
    rng = random.Random(5)
    words = "cc by general public license all rights reserved the of licensed under nc x é".split()
    for _ in range(400):
        text = "".join(rng.choice(words).upper() + rng.choice([" ", "-", ", ", "\n", "_"]) for _ in range(rng.randrange(0, 60)))
        assert licenses.scan_text(text)[:2] == plain_phrases(text)


def test_slices_give_the_same_as_the_whole():
    rng = random.Random(6)
    text = " ".join(rng.choice(["lorem", "ipsum", rng.choice(licenses.TEMPLATES)[1]]) for _ in range(200))
    whole = licenses.scanner().scan([words_of(text)])
    assert whole[2]
    for size in (1, 7, 100, 5000):
        assert licenses.scanner().scan(licenses.word_slices(text, size)) == whole


def labels(text):
    return {x[2] for x in licenses.scan_text(text)[2]}


def test_every_template_is_found_alone_and_changed():
    rng = random.Random(7)
    for label, text in licenses.TEMPLATES:
        assert labels("once upon " + text + " a time") == {label}, text
        words = text.split()
        if len(words) > 30:
            changed = [w for k, w in enumerate(words) if k % 15 != 7]  # every fifteenth word is missing
            changed = [x for k, w in enumerate(changed) for x in ((w, "indeed") if k % 20 == 11 else (w,))]
            assert labels(" ".join(changed)) == {label}, text
            assert labels(" ".join(words[: len(words) // 3])) == set()
    prose = " ".join(rng.choice("the of and to software license this is under free copy any use work".split()) for _ in range(5000))
    assert labels(prose) == set()


def test_spans_cover_the_template_words():
    words = licenses.TEMPLATES[4][1].split()
    total, _, spans, _ = licenses.scan_text("x y z " + " ".join(words[:40]) + " and so on " + " ".join(words[40:]) + " end")
    best = max(spans, key=lambda s: s[3])
    assert best[2] == "mit" and best[0] == 3 and best[4] == 1.0 and best[1] == total - 1


def test_many_repeats_stay_linear():
    text = "Permission is hereby granted, free of charge, to any person. " * 20_000
    n, base, spans, best = licenses.scan_text(text)
    assert n == 200_000 and base == [] and spans == [] and 0 < best < licenses.SHARE
    spans = licenses.scan_text("Released under the MIT License. " * 20_000)[2]
    assert len(spans) == 20_000 and {s[2] for s in spans} == {"mit"}


def test_query_on_tables(spark, documents, odd, none):
    for docs in (documents, odd):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, r.text)
        rows = licenses.digest_rows(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            n, base = plain_phrases(texts[r.doc_id] or "")
            starts = [s for s, _, _ in base]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(starts, default=None), max(starts, default=None))
            assert r.base_labels == ",".join(sorted({k for _, k, _ in base}))
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.digest_rows(none).count() == 0 and licenses.scan_licenses(none).count() == 0
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
    got = {r.doc_id: r for r in licenses.digest_rows(documents).collect()}
    seen = 0
    for r in documents.collect():
        for line, label in lines.items():
            if re.search(re.escape(line) + "$", r.text or ""):
                seen += 1
                assert label in got[r.doc_id].labels.split(",")
    assert seen
    spans = licenses.scan_licenses(documents).where("size(spans) > 0").first().spans
    assert spans[0].stop > spans[0].start
