"""Collocations against their SQL statement and against plain counting."""

from __future__ import annotations

import collections
import random
import re

from pyspark.sql import functions as F

from lexquarry.llm import collocations
from tests.helpers import duck_rows, spark_rows

DDL = "doc_id bigint, text string, lang string"


def plain_counts(rows):
    counts, totals = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    return counts, totals


def plain(rows, least, top):
    counts, totals = plain_counts(rows)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        holders = (c for (other, q), c in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if any(100 * c >= 100 * a for c in holders):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, l, rest, totals[lang], -score) for lang, found in out.items() for r, (score, a, p, l, rest) in enumerate(sorted(found)[:top], 1))


def found(spark, rows, least, top):
    docs = spark.createDataFrame(rows, DDL)
    return sorted(tuple(r) for r in collocations.mine_collocations(docs, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def generated(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "ba", "é", "ÄB", "A b", "x_y", "漢", "to"]
    common = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 12))) for _ in range(4)]
    texts = [None, "", " \t ", "...", "a a a a a a a a", "one"]
    for _ in range(n):
        parts = [rng.choice(common) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(1, 25))]
        texts.append("".join(p + rng.choice([" ", "  ", "\t", ", ", ".\n", " ", " "]) for p in parts))
    return [(k, t, rng.choice(["en", "de", None, "und"])) for k, t in enumerate(texts)]


def test_equal_to_plain_counting(spark):
    for seed, least, top in ((1, 2, 2000), (2, 5, 7)):
        rows = generated(seed, 60)
        assert found(spark, rows, least, top) == plain(rows, least, top)


def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    names, rows = spark_rows(collocations.mine_collocations(spark.read.parquet(f"{sf}/documents.parquet")))
    assert (names, rows) == duck_rows(collocations.ORACLE_SQL, sf) and rows


def test_odd_rows_and_long_texts(spark, odd, none):
    assert collocations.mine_collocations(none).collect() == []
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    got = collocations.mine_collocations(odd).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain(rows, 100, 2000) != []


def test_paths_hold_every_edge_once(spark):
    rng = random.Random(8)
    edges = {}
    for _ in range(40):
        w = [rng.choice("abcdefgh") * rng.choice([1, 1, 2, 3]) for _ in range(rng.randrange(5, 40))]
        for i in range(len(w) - 4):
            edges["en", " ".join(w[i : i + 5])] = edges.get(("en", " ".join(w[i : i + 5])), 0) + 1
    edges["en", "q q q q q"] = 9
    df = spark.createDataFrame([(k[0], k[1], 5, n) for k, n in edges.items()], "lang string, gram string, size int, n bigint")
    for buckets in (1, 7, 200):
        paths = collocations.compact_paths(df, buckets).collect()
        again = [((p.lang, " ".join(p.words[k : k + 5])), n) for p in paths for k, n in enumerate(p.weights)]
        assert len(again) == len(edges) and dict(again) == edges
        assert all(len(p.words) == len(p.weights) + 4 for p in paths)
    one = collocations.compact_paths(df, 1).collect()
    ends = collections.Counter()
    for p in one:
        if p.words[:4] != p.words[-4:]:
            ends[tuple(p.words[:4]), "out"] += 1
            ends[tuple(p.words[-4:]), "in"] += 1
    nodes = {v for v, _ in ends}
    assert not [v for v in nodes if ends[v, "in"] == 1 == ends[v, "out"] and sum(" ".join(v) + " " == g[: len(" ".join(v)) + 1] for _, g in edges) == 1]


def test_products_beyond_64_bits(spark):
    """Scores are floors of exact quotients, whatever the size of the counts."""
    a, n, l, r = 3 * 10**9 + 7, 9 * 10**12 + 1, 4 * 10**9 + 9, 5 * 10**9 + 11
    df = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint")
    assert df.select(collocations.score(*[F.col(c) for c in "anlr"])).first()[0] == 1000 * a * n // (l * r)
