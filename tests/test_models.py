"""Providers, nearest vectors, sealed records and the linear difference."""

from __future__ import annotations

import json
import os
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.operators import dense, providers, textdiff
from lexquarry.sources import records


def test_a_provider_is_made_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "made")
    os.makedirs(log)

    def make():
        with open(f"{log}/{os.getpid()}-{random.random()}", "w"):
            pass
        return providers.HashedWords(8)

    rows = spark.range(0, 2000, 1, 16).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("word "), "id")).alias("t"))
    got = {r.id: r.vector for r in providers.embed(rows, ["id"], "t", log, make, prefix="query ").collect()}
    made = os.listdir(log)
    assert len(made) == len({f.split("-")[0] for f in made}) <= 4 < 16  # one a Python worker, fewer than tasks
    model = providers.HashedWords(8)
    assert all(got[k] == model([f"query {f'word {k}' if k % 7 else ''}"])[0] for k in got) and len(got) == 2000


def test_a_provider_that_loses_vectors_is_refused(spark):
    with pytest.raises(Exception, match="1 vectors for 3 texts"):
        providers.embed(spark.range(0, 3, 1, 1).select("id", F.lit("x").alias("t")), ["id"], "t", "loses", lambda: lambda texts: [[1.0]]).collect()


def test_generated_answers_have_their_fields(spark):
    def make():
        asked = {}

        def say(system, user):
            asked[user] = asked.get(user, 0) + 1
            if user == "never":
                return "no json"
            if user == "later" and asked[user] == 1:
                return '{"value": 5}'
            return json.dumps({"value": user, "system": system})

        return say

    rows = spark.createDataFrame([(1, "s", "a"), (2, "s", "later"), (3, "s", "never"), (4, None, None)], "id int, s string, u string").coalesce(1)
    got = {r.id: (r.answer, r.attempts, r.error) for r in providers.generate(rows, ["id"], "s", "u", {"value": str}, "answers", make).collect()}
    assert got[1] == ('{"system": "s", "value": "a"}', 1, None) and got[2][1:] == (2, None)
    assert got[3][0] is None and got[3][2].startswith("no JSON") and json.loads(got[4][0]) == {"system": "", "value": ""}


def test_nearest_equals_a_full_sort(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = np.round(rng.normal(size=(300, 5)), 1)
    m[7] = 0
    m[50] = m[51]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id bigint, embedding array<double>").repartition(7)
    norm = np.linalg.norm(m, axis=1)
    cosine = np.round(np.divide(m @ m.T, np.outer(norm, norm), out=np.zeros((300, 300)), where=np.outer(norm, norm) > 0), 6) + 0.0
    for block in (4096, 4):
        monkeypatch.setattr(dense, "BLOCK", block)
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in dense.nearest(df, df.where("vec_id % 20 = 7 OR vec_id = 50"), 6).collect())
        want = [(q, k + 1, j, cosine[q, j]) for q in range(300) if q % 20 == 7 or q == 50 for k, j in enumerate(sorted((j for j in range(300) if j != q), key=lambda j: (-cosine[q, j], j))[:6])]
        assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert dense.nearest(df.where("vec_id < 0"), df, 3).count() == 0 == dense.nearest(df, df.where("vec_id < 0"), 3).count()


def test_a_changed_record_is_refused(spark, tmp_path):
    body = {"schema": "state/2", "b": [1, 2], "a": {"é": None}}
    good = records.sealed(body)
    files = {"good": good, "edited": good.replace("[1, 2]", "[1, 3]"), "other": records.sealed(body | {"schema": "state/1"}), "open": json.dumps(body), "broken": "{", "list": "[]"}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    got = {os.path.basename(r.path)[:-5]: (r.verified, r.refused, r.body) for r in records.read_records(spark, str(tmp_path), "state/2").collect()}
    assert got.pop("good") == (True, None, records.canonical(body))
    assert {k: v[1] for k, v in got.items()} == {"edited": "changed", "other": "another schema", "open": "no digest", "broken": "unreadable", "list": "another schema"}
    assert all(v[0] is False and v[2] is None for v in got.values())
    out = str(tmp_path / "written")
    records.write_records(spark.createDataFrame([(records.canonical(body),), (records.canonical(body | {"n": 2}),)], "body string"), out)
    lines = spark.read.text(out)
    assert records.check_lines(lines, "state/2").where("verified").count() == 2
    edited = lines.select(F.replace("value", F.lit("null"), F.lit("0")).alias("value"))
    assert {r.refused for r in records.check_lines(edited).collect()} == {"changed"}


def test_golden_sets_are_taken_whole(spark, tmp_path):
    good = {"categories": {"c": ""}, "goldens": [{"id": "a", "question": " q ", "kind": "present", "sections": [3], "category": "c"}, {"id": "b", "question": "q", "kind": "absent", "category": "c", "guidance": "g", "status": "pass"}]}
    bad = {"goldens": [{"id": "a", "kind": "present"}, {"id": "a", "kind": "absent"}, {"id": "c", "kind": "maybe"}, {"id": "d", "kind": "absent", "status": "pass"}, {"id": "e", "kind": "absent", "guidance": "g", "status": "fail"}]}
    for name, data in (("good", good), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    every = records.read_goldens(spark, str(tmp_path))
    why = {r.id + str(k): r.refused for k, r in enumerate(every.where("path LIKE '%bad%'").collect())}
    assert list(why.values()) == ["present without sections", "id not unique", "kind", "status without guidance", "status"]
    assert sorted((r.id, r.question, r.sections) for r in records.accepted_sets(every).collect()) == [("a", "q", ["3"]), ("b", "q", [])]


def test_the_linear_difference_is_as_long_as_the_table_s():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 30))] for _ in range(2))
        got = textdiff.common_pairs(a, b, anchored=False)
        assert len(got) == len(textdiff.common_items(a, b))
        for pairs in (got, textdiff.common_pairs(a, b)):
            assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    a = [str(k) for k in range(500)]
    b = [x for k, x in enumerate(a) if k % 9] + ["new"]
    assert len(textdiff.common_pairs(a, b)) == len(b) - 1
    old, new = "the fee is 5% a year", "the fee was 6% a year now"
    runs = textdiff.word_diff(old, new)
    assert "".join(t for k, t in runs if k != "added") == old and "".join(t for k, t in runs if k != "removed") == new


def test_long_texts_take_linear_memory():
    rng = random.Random(6)
    a = [rng.choice("abcdefgh") for _ in range(6000)]
    b = [x if rng.random() < 0.9 else rng.choice("abcdefgh") for x in a]
    tracemalloc.start()
    pairs = textdiff.common_pairs(a, b, anchored=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) > 5300 and peak < 20e6  # a table would have 36 million cells


def test_line_changes(spark):
    rows = [(1, "a\nb\nc", "a\nc\nd"), (2, None, "x"), (3, "", ""), (4, "same\n\nsame", "same\n\nsame")]
    got = textdiff.line_changes(spark.createDataFrame(rows, "id int, o string, n string"), ["id"], "o", "n").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, 1), (2, 0, 0, 1), (3, 0, 0, 0), (4, 3, 0, 0)]


def test_nearest_in_small_parts(spark, monkeypatch):
    rng = __import__("random").Random(4)
    df = spark.createDataFrame([(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(150)], "vec_id bigint, embedding array<double>").repartition(2)
    asked, rows = df.where("vec_id % 10 = 0"), lambda d: sorted(map(tuple, d.collect()))
    whole = rows(dense.nearest(df, asked, 4))
    monkeypatch.setattr(dense, "ASKED", 4)
    monkeypatch.setattr(dense, "ROWS", 7)
    assert rows(dense.nearest(df, asked, 4)) == whole and len(whole) == 15 * 4
