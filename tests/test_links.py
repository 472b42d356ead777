from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import links
from lexquarry.operators.numbering import letters, printed_numbers, roman
from lexquarry.operators.relations import assess, in_force, nearest, relations_in
from lexquarry.operators.textdiff import common_items, shared_run, word_diff

CLAUSES = [
    (0, "1", "Definitions", "“Customer Data” means data of the customer. “including” means “including without limitation”."),
    (1, "2", "Use", "The supplier may use Customer Data under Sections 3 and 4.2, not Section 365 of the Bankruptcy Code."),
    (2, "3", "Fees", "Fees are in Schedule A."),
    (3, "4", "Term", "One year."),
    (4, "9", "Changes", "Section 2 is hereby amended. Notwithstanding Clause 3, nothing else changes."),
    (5, "", "Schedule A", "Prices."),
]


@pytest.fixture(scope="module")
def sections(spark):
    return spark.createDataFrame([(7, *s) for s in CLAUSES] + [(9, 0, "1", None, None)], "doc_id bigint, ordinal int, number string, heading string, text string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_definitions_and_references(spark, sections):
    assert rows(links.definitions(sections), "doc_id", "term", "home") == [(7, "Customer Data", 0)]
    texts = [CLAUSES[1][3], None, "§§ 4.1, 4.2 and 5(a) & 6; clause 7.", "Section 2(a) of the Act", "Articles 3 or 4"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(links.numbers(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [["3", "4.2"], [], ["4.1", "4.2", "5", "6", "7"], [], ["3", "4"]]


def test_edges(sections):
    got = rows(links.links(sections), "source", "place", "target", "kind")
    assert got == [(1, 1, 4, "amendment"), (1, 2, 0, "definition"), (1, 3, 2, "reference"), (1, 4, 3, "reference"), (2, 1, 4, "override"), (2, 2, 5, "reference"), (4, 1, 1, "reference"), (4, 2, 2, "reference")]


def test_capitals_count_in_runs_only(spark):
    text = [(1, 0, "1", "", "“Net Fee” means x. “Policy” means y."), (1, 1, "2", "", "NET FEE is due."), (1, 2, "3", "", "NO NET FEE SHALL BE DUE."), (1, 3, "4", "", "The policies and Net Fees.")]
    s = spark.createDataFrame(text, "doc_id bigint, ordinal int, number string, heading string, text string")
    assert rows(links.uses(s, links.definitions(s)), "source", "term") == [(2, "Net Fee"), (3, "Net Fee")]


def test_following_keeps_its_budgets(spark, sections):
    found = links.links(sections)
    ranked = spark.createDataFrame([(7, 1, 1, 0), (8, 1, 0, 0)], "doc_id bigint, query_id bigint, ordinal int, rank int")
    assert rows(links.follow(sections, ranked, found), "doc_id", "step", "source", "target", "kind") == [(7, 1, 1, 4, "amendment"), (7, 2, 1, 0, "definition")]
    assert links.follow(sections, ranked, found, window=len(CLAUSES[1][3])).count() == 0
    added = links.follow(sections, ranked, found)
    assert rows(links.left_out(found, ranked, added), "target") == []
    assert rows(links.left_out(found, ranked, added.where("step = 2")), "source", "target") == [(1, 4)]
    assert rows(links.unseen(sections, ranked), "number") == [("3",)] and rows(links.unknown(sections), "number") == [("4.2",)]


def test_relations():
    text = "Clause 4 is hereby deleted and replaced by the following, effective 2030-01-01. In a conflict, Schedule B prevails over this Agreement. Clause 5 shall be replaced."
    found = relations_in(text)
    assert [(r.kind, r.names) for r in found] == [("replacement", ("4",)), ("precedence", ("Schedule B", "this Agreement")), ("replacement", ("5",))]
    assert [r.names for r in in_force(found, "2029-01-01")] == [("Schedule B", "this Agreement"), ("5",)]
    assert assess("4.1", [], found, "2029-01-01") == "pending" and assess("4.1", [], found, "2031-01-01") == "replaced"
    assert assess("4", [(0, len(text))], found, "2031-01-01") == "shown" and assess("6", [], found, "2031-01-01") == "clear"
    assert nearest(found, 0, 5, 1) == found[:1] and relations_in(None) == []


def test_numbering():
    assert [roman(n) for n in (4, 9, 14, 1994)] == ["iv", "ix", "xiv", "mcmxciv"] and [letters(n) for n in (1, 26, 27)] == ["a", "z", "aa"]
    levels = [("%1.", "decimal"), ("%1.%2", "decimal"), ("(%3)", "lower_letter")]
    assert printed_numbers([(0, None), (1, None), (2, None), (2, None), (1, None), (0, None), (1, 5), (9, None)], levels) == ["1.", "1.1", "(a)", "(b)", "1.2", "2.", "2.5", None]
    assert printed_numbers([(1, None), (0, None), (1, None)], levels) == [None, "1.", "1.1"]


def test_differences():
    assert common_items(list("abcd"), list("bxd")) == [(1, 0), (3, 2)]
    diff = word_diff("pay in 30 days", "pay within 30 business days")
    assert "".join(t for k, t in diff if k != "added") == "pay in 30 days" and "".join(t for k, t in diff if k != "removed") == "pay within 30 business days"
    assert shared_run("the fee is due now", ["a fee is due", "due now"]) == "fee is due" and shared_run("x", []) == ""


def test_equal_texts_are_read_once(spark):
    rows = [(d, *s) for d in range(40) for s in CLAUSES]
    known = links.read(spark.createDataFrame(rows, "doc_id bigint, ordinal int, number string, heading string, text string"))
    assert known.texts.count() == len(CLAUSES) and known.rows.count() == len(rows)
    found = links.links(known)
    assert found.groupBy("source", "place", "target", "kind").count().where("count <> 40").count() == 0 and found.count() == 40 * 8
    assert rows_of(links.resolve(spark.createDataFrame([(3, 1, "4.2"), (3, 3, "2"), (3, 4, "9")], "doc_id bigint, source int, number string"), known)) == [(1, "4.2", 3, 3), (3, "2", 1, 1)]


def rows_of(df):
    return rows(df, "source", "number", "target", "tier")


def test_steps_are_kept(spark, sections):
    """What is read besides ranked sections hangs on kept steps: its last plan joins a few small tables, not the whole graph again."""
    ranked = spark.createDataFrame([(7, 1, 1, 0), (7, 1, 2, 1)], "doc_id bigint, query_id bigint, ordinal int, rank int")
    found = links.links(sections)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(found) <= 3
    added = links.follow(sections, ranked, found.checkpoint())
    assert joins(added) <= 2 and rows(added, "step", "target") == [(1, 4), (2, 0)]
