"""Joins by cells against all pairs, lines against a plain walk, and statements of replacement."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import statements as s
from lexquarry.operators import intervals, page_layout, replacement


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(1)
    side = lambda n: [(rng.randrange(3), k, a := rng.randrange(0, 4000), a + rng.choice([0, 1, 5, 300, 3000])) for k in range(n)]
    left, right = side(150), side(150)
    got = intervals.overlap_join(spark.createDataFrame(left, "d int, i int, a int, b int"), spark.createDataFrame(right, "d int, j int, p int, q int"), ["d"], ("a", "b"), ("p", "q"), size=256)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    want = sorted((i, j) for d, i, a, b in left for e, j, p, q in right if d == e and a < q and p < b and a < b and p < q)
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_points_in_boxes_equal_all_pairs(spark):
    rng = random.Random(2)
    points = [(rng.randrange(2), k, rng.uniform(-100, 900), rng.uniform(-100, 900)) for k in range(400)] + [(0, 900, None, 1.0), (0, 901, 64.0, 128.0)]
    boxes = [(rng.randrange(2), k, x := rng.uniform(-100, 800), y := rng.uniform(-100, 800), x + rng.choice([-5, 0, 30, 900]), y + rng.choice([0, 40, 700])) for k in range(80)] + [(0, 99, 64.0, 64.0, 64.0, 128.0)]
    got = intervals.points_in_boxes(spark.createDataFrame(points, "p int, i int, x double, y double"), spark.createDataFrame(boxes, "p int, j int, x0 double, y0 double, x1 double, y1 double"), ["p"], "x", "y", ("x0", "y0", "x1", "y1"))
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    want = sorted((i, j) for p, i, x, y in points for q, j, x0, y0, x1, y1 in boxes if p == q and x is not None and x0 <= x <= x1 and y0 <= y <= y1)
    assert sorted((r.i, r.j) for r in got.collect()) == want and (901, 99) in want


def items(spark, rows):
    return spark.createDataFrame(rows, "page bigint, id bigint, x0 double, x1 double, y double, h double")


def test_lines_equal_a_plain_walk(spark):
    rng = random.Random(3)
    rows = [(p, k, rng.choice([0.0, 50.0, 90.0]), 100.0, float(rng.randrange(0, 60)), rng.choice([0.0, 6.0, 8.0, 12.0])) for p in range(5) for k in range(80)]
    want, anchor = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], -r[4], r[2], r[1])):
        p, y, h = r[0], r[4], max(r[5], 0.1)
        if p not in anchor or abs(anchor[p][1] - y) > 0.5 * min(h, anchor[p][2]):
            anchor[p] = (anchor.get(p, (0,))[0] + 1, y, h)
        want[p, r[1]] = anchor[p][0]
    assert {(r.page, r.id): r.line for r in page_layout.lines(items(spark, rows)).collect()} == want


def test_two_columns_of_prose_and_a_table(spark):
    rows, n = [], 0
    for line in range(6):  # two columns of four words a line, then a gap, then rows of single cells
        for x in (0, 26, 52, 78, 140, 166, 192, 218):
            rows.append((1, n := n + 1, float(x), float(x + 20), 700.0 - 12 * line, 10.0))
    for line in range(4):
        for x in (0, 140):
            rows.append((1, n := n + 1, float(x), float(x + 20), 560.0 - 12 * line, 10.0))
    lined = page_layout.lines(items(spark, rows))
    assert [tuple(r) for r in page_layout.gutters(lined).where("stop - start > 30").collect()] == [(1, 98.0, 140.0, 10, 10)]
    got = {r.band: (r.columns, r.lines, r.prose) for r in page_layout.prose_bands(lined.where("x1 - x0 < 99")).collect()}
    assert got == {1: (2, 6, True), 2: (2, 4, False)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Clause 4.1 is hereby deleted and replaced with: “Notice is 30 days. No more.” Fees stay.", [("replaces", "4.1", "Notice is 30 days. No more.", None, ())]),
        ("With effect from 1 March 1995, clause 3 is deleted.", [("replaces", "3", None, None, ("1995-03-01",))]),
        ("Clause 2 is replaced with “x” only for orders under Schedule A, and so on.", [("replaces", "2", "x", "only for orders under Schedule A", ())]),
        ("We delete clause 7. Replacing Section 2.2 with “a” is fine.", [("replaces", "7", None, None, ()), ("replaces", "2.2", "a", None, ())]),
        ("“Notice Period” now means thirty (30) days.", [("defines", "Notice Period", "“Notice Period” now means thirty (30) days.", None, ())]),
        ("Fees may be amended. Section 3 applies.", []),
        ("", []),
    ],
)
def test_statements(text, want):
    got = [(x.kind, x.target, text[slice(*x.wording)] if x.wording else None, x.scope, x.starts) for x in s.statements_in(text)]
    assert got == want


def test_precedence_and_parts():
    (found,) = s.statements_in("In case of conflict, this Amendment prevails over these General Terms and Schedule B.")
    assert [p for x in found.parts for p in s.ranked_part(x)] == ["amendment", "body", "schedule b"]
    assert s.statements_in("This Amendment prevails over the Agreement.") == []  # no conflict is spoken of
    assert [s.part_of_heading(h) for h in ("Amendment No. 1", "Schedule A prices", "Order Form", "Fees", None)] == ["amendment", "schedule a", "order form", None, None]
    asks = {"What is it now?": "current", "What was originally agreed?": "historical", "What applied in June 2025?": "dated", "What in 2024?": "dated", "What fee?": "unstated"}
    assert {q: s.perspective(q) for q in asks} == asks


def test_a_fresh_definition_replaces_the_body_s(spark):
    rows = [
        (1, 0, "1", "Terms", "“Notice Period” means ninety (90) days. Fees stay."),
        (1, 1, "2", "Fees", "Fees are due."),
        (1, 2, "", "Amendment No. 1", "With effect from 1 May 2020, “Notice Period” means 30 days. “Other Term” means x."),
        (1, 3, "", "Schedule A", "In any conflict this Schedule A and the Agreement take precedence."),
    ]
    sections = spark.createDataFrame(rows, "doc_id bigint, ordinal int, number string, heading string, text string")
    found, parts = replacement.relations(sections, F.lit("2024-01-01").cast("date"))
    got = sorted((r.at, r.kind, r.target, r.effective, r.scope, r.old_at, r.old_start, r.old_stop) for r in found.collect())
    assert got[0] == (2, "replaces", "Notice Period", "2020-05-01", None, 0, 0, 39) and got[1][:2] == (3, "precedence")
    assert sorted((r.ordinal, r.part) for r in parts.collect()) == [(0, "body"), (1, "body"), (2, "amendment"), (3, "schedule a")]
    findings = spark.createDataFrame([(1, 1, "What is the notice?", "90 days", None), (1, 2, "What is the notice?", "30 days", None), (1, 3, "Which fee?", "x", None)], "doc_id bigint, finding_id int, question string, answer string, observed string")
    spans = spark.createDataFrame([(1, 1, 0, 0, 20), (1, 2, 0, 0, 20), (1, 3, 1, 0, 5), (1, 3, 3, 0, 5)], "doc_id bigint, finding_id int, ordinal int, a int, b int")
    effects = replacement.assess(sections, found, parts, findings, spans)
    assert "NestedLoop" not in plan(effects) and "Cartesian" not in plan(effects)
    assert sorted((r.finding_id, r.effect) for r in effects.collect()) == [(1, "replaced"), (2, "context"), (3, "precedence")]
    later, _ = replacement.relations(sections, F.lit("2019-01-01").cast("date"))
    assert [r.scope for r in later.where("kind = 'replaces'").collect()] == ["from 2020-05-01"]
