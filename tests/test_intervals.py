"""Counting points in boxes without pairs."""

from __future__ import annotations

import random

import pytest

from lexquarry.operators import intervals
from lexquarry.plans import registry


@pytest.mark.parametrize("points, boxes", [(200_000, 200_000), (7, 3)])
def test_counts_are_those_of_all_pairs(spark, monkeypatch, points, boxes):
    monkeypatch.setattr(intervals, "POINTS", points)
    monkeypatch.setattr(intervals, "BOXES", boxes)
    rng = random.Random(2)
    p = [(rng.randrange(3), rng.choice([None, *map(float, range(12))]), rng.random() * 4 // 0.25) for _ in range(300)]
    q = [(rng.randrange(4), k // 2, *(float(rng.randrange(-1, 14)) for _ in range(4))) for k in range(60)]  # some turned round, ids twice, a page without points
    got = intervals.count_points_in_boxes(spark.createDataFrame(p, "page int, x double, y double"), spark.createDataFrame(q, "page int, box bigint, x0 double, y0 double, x1 double, y1 double"), ["page"], "x", "y", ("x0", "y0", "x1", "y1"), "box")
    want = {}
    for page, box, x0, y0, x1, y1 in q:
        want[box] = want.get(box, 0) + sum(g == page and x is not None and x0 <= x <= x1 and y0 <= y <= y1 for g, x, y in p)
    assert {r.box: r.n for r in got.collect()} == {b: n for b, n in want.items() if n}


def test_glyphs_make_no_pairs(spark, sf_dir):
    plan = registry.QUERIES["glyphs_in_boxes"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "__cx" not in plan and "FlatMapCoGroups" in plan


def test_pages_are_dealt_by_rows(spark, sf_dir, monkeypatch):
    """A task's rows have a bound that the session's partitions don't move."""
    from lexquarry import session
    from lexquarry.plans import layout
    from lexquarry.plans.base import Tables

    monkeypatch.setattr(session, "TASK_ROWS", 300)
    rows = layout.spans(Tables(spark, sf_dir))
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 300)
