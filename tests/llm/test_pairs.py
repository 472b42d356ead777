"""Near duplicates, repeated substrings and decontamination against brute force."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexquarry.llm import decontaminate, near_dedup, substring_dedup
from lexquarry.operators.components import connected_components

from .conftest import ODD
from tests.helpers import duck_rows, spark_rows


def brute_near(docs, shingle):
    """(doc, set size, component, kept) in input order, all pairs compared."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for _, t in docs:
        w = (t or "").encode().translate(low).split()
        sets.append(frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    n = len(docs)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            same = docs[i][0] is not None and docs[i][0] == docs[j][0]
            if docs[i][0] is None or docs[j][0] is None or not (same or sets[i] and sets[j]):
                continue
            if same or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        least = None if d is None else min(docs[j][0] for j in range(n) if find(j) == find(i))
        out.append((d, len(sets[i]), least, d == least))
    return out


def test_near_dedup_equals_sql(spark, documents, sf_dir):
    assert spark_rows(near_dedup.digest_rows(documents)) == duck_rows(near_dedup.ORACLE_SQL, sf_dir)


def test_near_dedup_on_odd_rows(odd, none):
    got = [tuple(r) for r in near_dedup.digest_rows(odd).collect()]
    assert sorted(got, key=str) == sorted(brute_near([(r[0], r[1]) for r in ODD], 4), key=str)
    assert near_dedup.digest_rows(none).count() == 0


def test_large_groups_with_and_without_the_original(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    passage = [rng.choice(words) for _ in range(60)]
    docs = [(0, " ".join(base))]
    for k in range(1, 160):  # edits of one original; of each other some are similar, some not
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(w)))
    second = list(base)
    second[20:60] = [rng.choice(words) for _ in range(40)]  # another original, unlike the first
    for k in range(200, 330):
        w = list(second)
        for _ in range(rng.choice([1, 2, 4])):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        docs.append((k, " ".join(w)))
    for k in range(400, 560):  # one common passage in unlike documents
        docs.append((k, " ".join(passage + [f"z{rng.randrange(10**6)}" for _ in range(50)])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [tuple(r) for r in near_dedup.near_duplicates(df, shingle=4, small=16).collect()]
    assert sorted(got) == sorted(brute_near(docs, 4))


def test_estimate_is_close_and_prefixes_meet():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(20, 900))
        both = rng.integers(0, 2**63, n).astype(np.uint64)
        a = np.unique(np.concatenate([both, rng.integers(0, 2**63, n // 9).astype(np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 2**63, n // 9).astype(np.uint64)]))
        x, y, heavy = a[:64], b[:64], np.zeros(near_dedup.BUCKETS, np.int64)
        assert near_dedup.estimate(x, y, 64) >= near_dedup.LEAST_SHARED / 64
        px, py = (near_dedup.prefix(v, heavy, 0.8, 64, near_dedup.LEAST_SHARED) for v in (x, y))
        assert len(np.intersect1d(px, py))


def test_components(spark):
    got = {tuple(r) for r in connected_components(spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4)], "a bigint, b bigint")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 8), (8, 8)}


def test_substrings_equal_brute_force(spark, documents, odd, none):
    key = lambda r: str(tuple(r))
    for df in (documents, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in substring_dedup.digest_rows(df).collect()), key=key) == sorted(substring_dedup.brute_force(rows), key=key)
    assert substring_dedup.digest_rows(none).count() == 0


def _local(docs, chunks, buckets, length, seed):
    """The operator's steps without Spark."""
    cut = [substring_dedup.Chunk([i for i, _ in docs[k::chunks]], [(t or "").encode() for _, t in docs[k::chunks]]) for k in range(chunks)]
    box: dict = {}
    for k, c in enumerate(cut):
        for b, m in substring_dedup.seed_messages(c, buckets, length, seed):
            box.setdefault(b, []).append((k, m))
    answers: list[dict] = [{} for _ in cut]
    for b, rows in box.items():
        for k, m in substring_dedup.repeated_seeds(rows):
            answers[k][b] = m
    places = [substring_dedup.Places(c, a, buckets, length, seed) for c, a in zip(cut, answers)]
    box = {}
    for k, p in enumerate(places):
        for b, m in p.messages():
            box.setdefault(b, []).append((k, m))
    masks: list[dict] = [{} for _ in cut]
    for b, rows in box.items():
        for k, m in substring_dedup.window_masks(rows, length, seed):
            masks[k][b] = m
    return [(i, len(t), sum(e - s for s, e in sp), len(sp)) for c, p, m in zip(cut, places, masks) for i, t, sp in zip(c.ids, c.texts, p.removed(m))]


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_substring_steps_on_small_alphabets(data):
    length, seed = data.draw(st.sampled_from([(16, 8), (20, 9)]))
    block = st.text("abc é", max_size=60)
    base = data.draw(st.lists(block, min_size=1, max_size=4))
    texts = data.draw(st.lists(st.lists(st.sampled_from([*base, "x", ""]), max_size=4).map("".join), min_size=1, max_size=8))
    docs = [(data.draw(st.sampled_from([k, k, None, 2])), t) for k, t in enumerate(texts)]
    got = _local(docs, data.draw(st.integers(1, 3)), data.draw(st.integers(1, 3)), length, seed)
    assert sorted(got, key=str) == sorted((r[:4] for r in substring_dedup.brute_force(docs, length)), key=str)


def test_suffix_merge_sort_orders_suffixes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    hashes = substring_dedup.PrefixHashes(data)
    start = rng.permutation(2900)[:700].astype(np.int64)
    group = np.sort(rng.integers(0, 5, 700))
    order = substring_dedup.suffix_merge_sort(start, group, hashes, 50)
    raw = data.tobytes()
    keys = [(int(group[k]), raw[start[k] : start[k] + 50]) for k in order]
    assert keys == sorted(keys) and (group[order] == group).all()


def test_decontamination_equals_brute_force(spark, documents, odd, none, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = spark.createDataFrame([(1, "brown fox jumps"), (2, None), (3, ""), (4, "One TWO"), (5, "quick brown fox jumps over the lazy dog and runs far away into the"), (5, "one two")], "item_id bigint, text string")
    for docs, bench in ((documents, benchmark), (odd, items), (odd, items.where("false")), (none, items)):
        want = decontaminate.brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
        assert sorted((tuple(r) for r in decontaminate.digest_rows(docs, bench).collect()), key=str) == sorted(want, key=str)


def test_blocks_of_the_benchmark_give_the_same(spark, documents, sf_dir, monkeypatch):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(map(str, decontaminate.digest_rows(documents, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2500)
    assert sorted(map(str, decontaminate.digest_rows(documents, benchmark).collect())) == one


def test_blocks_keep_rows_of_one_id_apart(spark, monkeypatch):
    rows = [(1, "a one two b"), (1, "a b three four"), (1, "a one two b"), (None, "one two c d"), (None, "c d three four"), (2, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = [(1, "one two"), (2, "three four"), (3, "five six"), (4, "a b")]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 5)
    got = [tuple(r) for r in decontaminate.digest_rows(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()]
    assert sorted(got, key=str) == sorted(decontaminate.brute_force(rows, items), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30).map(" ".join), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=7).map(" ".join), max_size=4))
def test_index_on_small_alphabets(docs, items):
    docs, items = list(enumerate(docs)), list(enumerate(items))
    found = decontaminate.search_shard([t for _, t in docs], decontaminate.Phrases([(str(i), t) for i, t in items], 4))
    got = [(d, n, sum(b - a for a, b in spans), len(names)) for (d, _), (n, spans, names) in zip(docs, found)]
    assert got == [r[:4] for r in decontaminate.brute_force(docs, items, 4)]


def test_only_texts_of_pairs_are_sent(spark):
    """The exact comparison shuffles the texts of paired ids; copies of an id stay, a text of no pair goes nowhere."""
    texts = spark.range(-3000, 3000).selectExpr("id", "concat('t', id) AS text").unionByName(spark.createDataFrame([(7, "another"), (7, None)], "id bigint, text string"))
    pairs = spark.createDataFrame([(-3000, 7), (7, 2999), (0, -1)], "a bigint, b bigint")
    kept = sorted((r.id, r.text or "") for r in near_dedup.paired_texts(texts, pairs).collect())
    must = [(-3000, "t-3000"), (-1, "t-1"), (0, "t0"), (7, ""), (7, "another"), (7, "t7"), (2999, "t2999")]
    assert set(must) <= set(kept) and len(kept) <= len(must) + 10
