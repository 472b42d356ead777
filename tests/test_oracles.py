"""Every query with an oracle statement gives its rows; the others run and give rows of their schema."""

from __future__ import annotations

import pytest

from lexquarry.plans import registry

from .helpers import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == duck_rows(registry.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_no_cartesian_products(spark, sf_dir):
    for name in ("quote_exact_places", "shingle_jaccard_pairs", "bm25_topk"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
