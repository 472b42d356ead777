"""Scoring and reporting: rates, sweeps, percentiles, populations, comparisons of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.numbers import index_percentile, spreadsheet_cell

from .base import query


@query("""
SELECT event_type, count(*)::BIGINT AS n, round(list_sort(list(value))[round_even(0.5 * (count(*) - 1), 0)::INT + 1], 1) AS p50, round(list_sort(list(value))[round_even(0.95 * (count(*) - 1), 0)::INT + 1], 1) AS p95
FROM events GROUP BY event_type
""")
def percentile_round_index(t) -> DataFrame:
    """Percentiles by the half-even rounded index f * (n - 1), one decimal.

    Ranks come from counts of distinct values, so a group is never gathered in one list.
    """
    return index_percentile(t.events.select("event_type", "value"), "event_type", "value", {"p50": 0.5, "p95": 0.95}, 1)


@query("""
SELECT n_nationkey, seg AS field, min(c_custkey) AS run, CASE WHEN min(c_custkey) IS NULL THEN 'missing' ELSE 'done' END AS state
FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) f LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = seg AND c_acctbal > 9000 GROUP BY 1, 2
""")
def population_left_join(t) -> DataFrame:
    """Every pre-registered pair of document and field, with its first run or none."""
    pairs = t.nation.select("n_nationkey").join(F.broadcast(t.customer.select(F.col("c_mktsegment").alias("field")).distinct()), F.lit(True))  # both sides are dimensions
    runs = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("field")).agg(F.min("c_custkey").alias("run"))
    return pairs.join(runs, ["n_nationkey", "field"], "left").select("n_nationkey", "field", "run", F.when(F.col("run").isNull(), "missing").otherwise("done").alias("state"))


@query("""
SELECT coalesce(event_type, 'all') AS category, count(*)::BIGINT AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY ROLLUP (event_type)
""")
def rates_with_all_row(t) -> DataFrame:
    """Rates by category and one row for all."""
    rate = F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6)
    return t.events.rollup("event_type").agg(F.count("*").alias("n"), rate.alias("rate")).select(F.coalesce("event_type", F.lit("all")).alias("category"), "n", "rate")


@query("""
WITH firsts AS (SELECT o_custkey, o_orderpriority, min_by(o_orderstatus, o_orderkey) AS s, count(*) AS created FROM orders GROUP BY 1, 2)
SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN s END) AS urgent, max(CASE WHEN o_orderpriority = '2-HIGH' THEN s END) AS high,
max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN s END) AS medium, sum(created - 1)::BIGINT AS reused FROM firsts GROUP BY 1
""")
def batch_report_pivot(t) -> DataFrame:
    """First value of each (document, field), fields as columns, with the number of reused runs."""
    firsts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min_by("o_orderstatus", "o_orderkey").alias("s"), F.count("*").alias("created"))
    cell = lambda k: F.max(F.when(F.col("o_orderpriority") == k, F.col("s")))
    return firsts.groupBy("o_custkey").agg(cell("1-URGENT").alias("urgent"), cell("2-HIGH").alias("high"), cell("3-MEDIUM").alias("medium"), F.sum(F.col("created") - 1).alias("reused"))


@query("""
SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_name, p_partkey) AS rn, count(*) OVER () AS n FROM part WHERE p_size BETWEEN 10 AND 40) x
WHERE (rn - 1) % greatest(1, n // 30) = 0 ORDER BY p_name, p_partkey LIMIT 30
""")
def systematic_sample(t) -> DataFrame:
    """Every k-th of the eligible rows by name, k = n div 30, the first 30: global ranks from a range-partitioned sort."""
    from lexquarry.operators.ranking import global_rank

    eligible = t.part.where("p_size BETWEEN 10 AND 40").select("p_partkey", "p_name")
    step = max(1, eligible.count() // 30)
    ranked = global_rank(eligible, ["p_name", "p_partkey"], "rn")
    return ranked.where((F.col("rn") - 1) % step == 0).orderBy("p_name", "p_partkey").limit(30).select("p_partkey", "p_name")


@query("""
SELECT outcome, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN n_chars = 0 THEN 'failed' WHEN toxic = 1 AND n_chars > 2000 THEN 'hit'
WHEN toxic = 1 THEN 'missed' WHEN quality = 0 AND n_chars > 2000 THEN 'wrong' WHEN quality = 0 THEN 'absent_agreed' WHEN n_chars < 200 THEN 'withheld' ELSE 'answered' END AS outcome
FROM documents d LEFT JOIN labels l USING (doc_id)) x GROUP BY outcome
""")
def outcome_counts(t) -> DataFrame:
    """One outcome for each run, by an ordered rule list."""
    rows = t.documents.select("doc_id", "n_chars").join(t.labels.withColumn("known", F.lit(True)), "doc_id", "left")
    outcome = (
        F.when(F.col("known").isNull(), "unlabelled")
        .when(F.col("n_chars") == 0, "failed")
        .when((F.col("toxic") == 1) & (F.col("n_chars") > 2000), "hit")
        .when(F.col("toxic") == 1, "missed")
        .when((F.col("quality") == 0) & (F.col("n_chars") > 2000), "wrong")
        .when(F.col("quality") == 0, "absent_agreed")
        .when(F.col("n_chars") < 200, "withheld")
        .otherwise("answered")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT count(CASE WHEN toxic = 1 AND quality = 1 THEN 1 END) AS tp, count(CASE WHEN toxic = 1 AND quality = 0 THEN 1 END) AS fp, count(CASE WHEN toxic = 0 AND quality = 1 THEN 1 END) AS fn FROM labels)
SELECT round(tp / (tp + fp), 6) AS prec, round(tp / (tp + fn), 6) AS recall, CASE WHEN tp / (tp + fp) >= 0.8 AND tp / (tp + fn) >= 0.5 THEN 'met' ELSE 'not met' END AS verdict FROM s
""")
def verdict_against_floors(t) -> DataFrame:
    flag = lambda a, b: F.count_if((F.col("toxic") == a) & (F.col("quality") == b))
    s = t.labels.agg(flag(1, 1).alias("tp"), flag(1, 0).alias("fp"), flag(0, 1).alias("fn"))
    prec, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return s.select(F.round(prec, 6).alias("prec"), F.round(recall, 6).alias("recall"), F.when((prec >= 0.8) & (recall >= 0.5), "met").otherwise("not met").alias("verdict"))


@query(r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^[\t\r]') OR regexp_matches(ltrim(text), '^[=+@-]') THEN '''' || text ELSE text END AS cell FROM conversations
""")
def csv_cell_escape(t) -> DataFrame:
    """Cells that a spreadsheet would run as a formula get an apostrophe in front."""
    return t.conversations.select("conv_id", "turn", spreadsheet_cell(F.col("text")).alias("cell"))


@query("""
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'pending' WHEN a.s = b.s THEN 'same' WHEN a.s < b.s THEN 'better' ELSE 'worse' END AS change
FROM (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) a
FULL JOIN (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1) b ON a.o_custkey = b.o_custkey
""")
def recording_compare(t) -> DataFrame:
    """Base against head recording: the best run of each side, full outer."""
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    best = lambda rows, name: rows.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias(name))
    both = best(t.orders.where(F.col("o_orderdate") < cut), "a").join(best(t.orders.where(F.col("o_orderdate") >= cut), "b"), "o_custkey", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "pending").when(F.col("a") == F.col("b"), "same").when(F.col("a") < F.col("b"), "better").otherwise("worse")
    return both.select("o_custkey", change.alias("change"))


@query("""
SELECT substr(p_name, 1, 4) AS family, count(*)::BIGINT AS n, count(DISTINCT p_brand)::BIGINT AS brands FROM part GROUP BY 1 HAVING count(*) > 1
""")
def prefix_entity_merge(t) -> DataFrame:
    """Entities merged by prefix, those with several members."""
    return t.part.groupBy(F.substring("p_name", 1, 4).alias("family")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands")).where("n > 1")


@query("""
WITH x AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT x.h, count(*)::BIGINT AS copies, min(doc_id) AS first_id, count(label_rows.doc_id)::BIGINT AS labelled
FROM x LEFT JOIN labels label_rows USING (doc_id) GROUP BY x.h HAVING count(*) > 1
""")
def duplicate_census(t) -> DataFrame:
    """Contents held more than once, with how many of their holders are labelled."""
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h")).join(t.labels.select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    return rows.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.count("known").alias("labelled")).where("copies > 1")


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_custkey % 7 AS n FROM customer)
SELECT coalesce(a.k, b.k) AS k, a.n::BIGINT AS stored, b.n::BIGINT AS projected FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n
""")
def projection_disagreements(t) -> DataFrame:
    """Keys on which two projections of the record do not agree."""
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("stored"))
    b = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 7).alias("projected"))
    return a.join(b, "k", "full").where("NOT (stored <=> projected)")


@query("""
SELECT d.doc_id, count(CASE WHEN length(d.text) > 2000 THEN 1 END)::BIGINT AS beyond, sum(greatest(0, length(d.text) - 2000))::BIGINT AS chars_outside FROM documents d GROUP BY d.doc_id
""")
def prompt_window_census(t) -> DataFrame:
    """Characters of each document outside the window that is read."""
    n = F.length("text")
    return t.documents.groupBy("doc_id").agg(F.count_if(n > 2000).alias("beyond"), F.sum(F.greatest(F.lit(0), n - 2000)).alias("chars_outside"))


@query("""
WITH x AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT event_type, count(*)::BIGINT AS n, min(date_diff('second', ts, nxt))::BIGINT AS shortest, max(date_diff('second', ts, nxt))::BIGINT AS longest FROM x WHERE nxt IS NOT NULL GROUP BY event_type
""")
def load_levels(t) -> DataFrame:
    """Waiting time from each stage to the next, by stage."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    wait = F.unix_timestamp(F.col("nxt").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = t.events.withColumn("nxt", F.lead("ts").over(w)).where("nxt IS NOT NULL")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min(wait).alias("shortest"), F.max(wait).alias("longest"))


@query("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS source_no, coalesce(nullif(role, 'system'), 'rules') AS label FROM conversations
""")
def numbered_sources(t) -> DataFrame:
    """Sources numbered in reading order, with a label override."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.row_number().over(w).cast("bigint").alias("source_no"), F.coalesce(F.nullif("role", F.lit("system")), F.lit("rules")).alias("label"))


@query("""
WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS rn FROM part)
SELECT p_partkey, CASE WHEN (rn - 1) % 10 < 6 THEN 'train' WHEN (rn - 1) % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM r WHERE (rn - 1 - 6) % 5 = 0
""")
def positional_split(t) -> DataFrame:
    """An offset systematic sample, split by position."""
    from lexquarry.operators.ranking import global_rank

    r = global_rank(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], "rn").where("(rn - 1 - 6) % 5 = 0")
    at = (F.col("rn") - 1) % 10
    return r.select("p_partkey", F.when(at < 6, "train").when(at < 8, "val").otherwise("test").alias("split"))


@query("""
SELECT event_type, sum(CASE WHEN value > 90 THEN 1.0 WHEN value > 50 THEN 0.5 ELSE 0 END)::DOUBLE AS soft, count(CASE WHEN value > 90 THEN 1 END)::BIGINT AS hard FROM events GROUP BY event_type
""")
def scored_rollout(t) -> DataFrame:
    soft = F.when(F.col("value") > 90, 1.0).when(F.col("value") > 50, 0.5).otherwise(0.0)
    return t.events.groupBy("event_type").agg(F.sum(soft).alias("soft"), F.count_if(F.col("value") > 90).alias("hard"))


@query("""
SELECT source, bool_or(toxic = 1) AS caught_any, bool_and(toxic = 1) AS caught_every, count(*)::BIGINT AS sessions FROM documents JOIN labels USING (doc_id) GROUP BY source
""")
def fix_score(t) -> DataFrame:
    hit = F.col("toxic") == 1
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.bool_or(hit).alias("caught_any"), F.bool_and(hit).alias("caught_every"), F.count("*").alias("sessions"))


@query("""
WITH g AS (SELECT l_orderkey, min(l_linenumber) AS first_at, bool_or(l_returnflag = 'R') AS flagged FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS attention, flagged FROM lineitem JOIN g USING (l_orderkey)
""")
def attention_order(t) -> DataFrame:
    """What a reader sees first: findings ranked by verdict, with whether their document has a flagged one."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("flagged"))
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return t.lineitem.select("l_orderkey", "l_linenumber", rank.alias("attention")).join(g, "l_orderkey")


#: Floors of a recording; retrieval is the cause where over one miss in so many had no span of the expert's among its sections.
PRECISION_FLOOR, RECALL_FLOOR, RETRIEVAL_ONE_IN = 0.3, 0.25, 3
_OUTCOME = """CASE WHEN n_chars < 60 THEN 'failed' WHEN toxic = 1 AND n_chars % 3 = 0 THEN 'missed' WHEN toxic = 1 AND n_chars % 3 = 1 THEN 'cited elsewhere' WHEN toxic = 1 THEN 'correct'
WHEN quality = 0 AND n_chars % 2 = 0 THEN 'asserted' ELSE 'correct absence' END"""


@query(f"""
WITH o AS (SELECT lang, source, {_OUTCOME} AS outcome, n_chars % 5 <> 0 AS carried FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, source, count(*) AS n, count(CASE WHEN outcome = 'correct' THEN 1 END) AS correct, count(CASE WHEN outcome IN ('cited elsewhere', 'asserted') THEN 1 END) AS wrong,
  count(CASE WHEN outcome IN ('missed', 'cited elsewhere') THEN 1 END) AS missed, count(CASE WHEN outcome IN ('missed', 'cited elsewhere') AND NOT carried THEN 1 END) AS unretrieved, count(CASE WHEN outcome = 'failed' THEN 1 END) AS unfinished FROM o GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN correct + wrong = 0 THEN 0 ELSE correct / (correct + wrong) END AS prec, CASE WHEN correct + missed + unfinished = 0 THEN 0 ELSE correct / (correct + missed + unfinished) END AS recall FROM c)
SELECT lang, source, n::BIGINT AS n, unfinished::BIGINT AS unfinished, round_even(prec, 4) AS prec, round_even(recall, 4) AS recall,
  CASE WHEN unfinished > 0 THEN 'not scorable' WHEN prec >= {PRECISION_FLOOR} AND recall >= {RECALL_FLOOR} THEN 'fit' ELSE 'not fit' END AS verdict,
  CASE WHEN missed = 0 THEN NULL WHEN {RETRIEVAL_ONE_IN} * unretrieved > missed THEN 'retrieval' ELSE 'model' END AS cause FROM r
""")
def recording_verdicts(t) -> DataFrame:
    """The verdict on each recording, a language and source: not scorable with an unfinished value, which also counts as a miss;
    else by the floors; and whether its misses are retrieval's."""
    o = t.documents.join(t.labels, "doc_id").select("lang", "source", F.expr(_OUTCOME).alias("outcome"), (F.col("n_chars") % 5 != 0).alias("carried"))
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    c = o.groupBy("lang", "source").agg(
        F.count("*").alias("n"), of("correct").alias("correct"), of("cited elsewhere", "asserted").alias("wrong"), of("missed", "cited elsewhere").alias("missed"),
        F.count_if(F.col("outcome").isin("missed", "cited elsewhere") & ~F.col("carried")).alias("unretrieved"), of("failed").alias("unfinished"),
    )
    share = lambda below: F.when(below == 0, 0.0).otherwise(F.col("correct") / below)
    prec, recall = share(F.col("correct") + F.col("wrong")), share(F.col("correct") + F.col("missed") + F.col("unfinished"))
    verdict = F.when(F.col("unfinished") > 0, "not scorable").when((prec >= PRECISION_FLOOR) & (recall >= RECALL_FLOOR), "fit").otherwise("not fit")
    cause = F.when(F.col("missed") > 0, F.when(RETRIEVAL_ONE_IN * F.col("unretrieved") > F.col("missed"), "retrieval").otherwise("model"))
    return c.select("lang", "source", "n", "unfinished", F.bround(prec, 4).alias("prec"), F.bround(recall, 4).alias("recall"), verdict.alias("verdict"), cause.alias("cause"))


@query("""
WITH x AS (SELECT user_id % 5 AS level, event_type, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0::DOUBLE AS wait, value FROM events),
w AS (SELECT level, list_sort(list(wait) FILTER (WHERE wait IS NOT NULL)) AS waits, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, max(value) AS peak, count(*) AS n FROM x GROUP BY level)
SELECT level, n::BIGINT AS n, failed::BIGINT AS failed, peak, round(waits[round_even(0.5 * (len(waits) - 1), 0)::INT + 1], 1) AS p50, round(waits[round_even(0.95 * (len(waits) - 1), 0)::INT + 1], 1) AS p95 FROM w
""")
def load_envelope(t) -> DataFrame:
    """Each load level's queue times by index percentiles, with its failures and its peak; the last stage of a user waits for none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t.events.select((F.col("user_id") % 5).alias("level"), "event_type", "value", ((F.lead(us).over(w) - us) / 1000000).alias("wait"))
    waits = index_percentile(rows.where("wait IS NOT NULL").select("level", "wait"), "level", "wait", {"p50": 0.5, "p95": 0.95}, 1)
    counts = rows.groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("value").alias("peak"))
    return counts.join(waits.select("level", "p50", "p95"), "level", "left").select("level", "n", "failed", "peak", "p50", "p95")
