"""The relational record: the query shapes of the run store, over the star-schema tables that stand in for it.

customer = workspaces/documents' holders, orders = runs, lineitem = findings, events = run stages and reviews,
conversations = append-only reviews, part = guidance, supplier = readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import query


@query("""
SELECT c_custkey, c_name, count(o_orderkey)::BIGINT AS sections FROM customer LEFT JOIN orders ON o_custkey = c_custkey
WHERE c_acctbal > 0 GROUP BY c_custkey, c_name
""")
def docs_outer_count(t) -> DataFrame:
    """Parents with the number of their children, 0 where there is none."""
    counts = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("sections"))
    parents = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name")
    return parents.join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", F.coalesce("sections", F.lit(0)).alias("sections"))


@query("""
SELECT o_custkey, count(*)::BIGINT AS findings FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F') r
JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N' GROUP BY o_custkey
""")
def findings_per_document(t) -> DataFrame:
    """Findings that need attention, over complete runs only, by document."""
    runs = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    found = t.lineitem.where("l_returnflag <> 'N'").select("l_orderkey")
    return runs.join(found, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("findings"))


@query("""
WITH latest AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN latest USING (conv_id, turn) WHERE c.role <> 'system'
""")
def latest_review_not_cleared(t) -> DataFrame:
    """The standing review of each finding: the latest, if it does not clear; the filter comes after the ranking."""
    latest = t.conversations.groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("m"))
    return latest.select("conv_id", "m.turn", "m.role").where("role <> 'system'")


@query("SELECT o_custkey, max(o_orderdate) AS last_run FROM orders GROUP BY o_custkey")
def last_run_per_document(t) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_run"))


@query("""
SELECT l_orderkey, l_linenumber, c_name, l_returnflag, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE l_returnflag = 'R' AND o_orderstatus = 'F' AND c_acctbal > 0 ORDER BY o_orderdate DESC, l_orderkey, l_linenumber LIMIT 500
""")
def findings_list_top500(t) -> DataFrame:
    """The newest 500 findings with their run and document, in a total order."""
    rows = (
        t.lineitem.where("l_returnflag = 'R'")
        .join(t.orders.where("o_orderstatus = 'F'"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"))
        .select("l_orderkey", "l_linenumber", "c_name", "l_returnflag", "o_orderdate")
    )
    return rows.orderBy(F.desc("o_orderdate"), "l_orderkey", "l_linenumber").limit(500)


@query("""
SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY first_line, l_suppkey) AS citations FROM
(SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey, l_suppkey) x GROUP BY l_orderkey
""")
def distinct_citations(t) -> DataFrame:
    """The distinct sources of each finding list, in the order of their first use."""
    firsts = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first_line", F.col("l_suppkey").alias("k")))), lambda x: x["k"].cast("string"))
    return firsts.groupBy("l_orderkey").agg(F.concat_ws(",", ordered).alias("citations"))


@query("""
SELECT 'runs' AS part, o_orderstatus AS name, NULL::BOOLEAN AS verified, count(*)::BIGINT AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'findings', l_returnflag, NULL, count(*)::BIGINT, NULL, NULL FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'spans', l_linestatus, l_discount > 0.05, count(*)::BIGINT, NULL, NULL FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_linestatus, l_discount > 0.05
""")
def method_counts(t) -> DataFrame:
    """The citation record: runs by stage with their time range, findings by status, spans by method and verdict."""
    none, at = F.lit(None).cast("boolean").alias("verified"), [F.lit(None).cast("timestamp_ntz").alias(n) for n in ("first_at", "last_at")]
    runs = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))
    runs = runs.select(F.lit("runs").alias("part"), F.col("o_orderstatus").alias("name"), none, "n", "first_at", "last_at")
    found = t.lineitem.groupBy("l_returnflag").count().select(F.lit("findings").alias("part"), F.col("l_returnflag").alias("name"), none, F.col("count").alias("n"), *at)
    spans = t.lineitem.join(t.orders.select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    spans = spans.groupBy(F.col("l_linestatus").alias("name"), (F.col("l_discount") > 0.05).alias("verified")).agg(F.count("*").alias("n"))
    return runs.unionByName(found).unionByName(spans.select(F.lit("spans").alias("part"), "name", "verified", "n", *at))


@query("""
WITH newest AS (SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200)
SELECT o_orderkey, o_orderdate, o_orderstatus, count(CASE WHEN l_returnflag = 'A' THEN 1 END)::BIGINT AS n_a, count(CASE WHEN l_returnflag = 'N' THEN 1 END)::BIGINT AS n_n,
count(CASE WHEN l_returnflag = 'R' THEN 1 END)::BIGINT AS n_r FROM newest LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
""")
def runs_list_top200(t) -> DataFrame:
    """The newest 200 runs with their outcome counts."""
    newest = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)
    joined = newest.join(t.lineitem.select("l_orderkey", "l_returnflag"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy("o_orderkey", "o_orderdate", "o_orderstatus").agg(*[F.count_if(F.col("l_returnflag") == k).alias(f"n_{k.lower()}") for k in "ANR"])


@query("""
SELECT a.o_orderkey, (SELECT count(*) FROM orders b WHERE b.o_orderstatus <> 'F' AND b.o_orderdate < a.o_orderdate)::BIGINT AS ahead FROM orders a WHERE a.o_orderstatus <> 'F'
""")
def queue_ahead_count(t) -> DataFrame:
    """Open runs created strictly before each open run: running totals of the counts by creation time.

    Times are aggregated first, split by day, and the day totals are carried on, so no task holds all runs.
    """
    per_time = t.orders.where("o_orderstatus <> 'F'").groupBy("o_orderdate").agg(F.count("*").alias("n"))
    per_time = per_time.withColumn("month", F.date_trunc("month", "o_orderdate"))
    months = per_time.groupBy("month").agg(F.sum("n").alias("m"))  # one row for each month of the record
    before = months.alias("a").join(months.alias("b"), F.col("b.month") < F.col("a.month"), "left").groupBy("a.month").agg(F.coalesce(F.sum("b.m"), F.lit(0)).alias("base"))
    w = Window.partitionBy("month").orderBy("o_orderdate").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_time.join(before, "month").select("o_orderdate", (F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("ahead"))
    return t.orders.where("o_orderstatus <> 'F'").join(ahead, "o_orderdate").select("o_orderkey", "ahead")


@query("SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR source = 'src1'")
def run_visibility(t) -> DataFrame:
    """Own rows or curated ones: NULL names the curated owner and is never coalesced."""
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left").where("quality IS NULL OR source = 'src1'").select("doc_id", "source")


@query("""
SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
""")
def visible_not_exists_or_exists(t) -> DataFrame:
    """Without any grant, or with an own one: one existence flag a key, joined once."""
    flags = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("own"))
    joined = t.customer.join(flags, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.where("o_custkey IS NULL OR own").select("c_custkey", "c_mktsegment")


@query("""
SELECT date_trunc('day', ts) AS day, coalesce(sum(CASE WHEN event_type LIKE 'p%' THEN value END), 0) > 0 AS any_bytes, count(CASE WHEN event_type LIKE 'p%' THEN 1 END)::BIGINT AS uploads,
round(coalesce(sum(CASE WHEN event_type LIKE 'p%' THEN value END), 0), 4) AS bytes FROM events e WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) GROUP BY 1
""")
def public_bytes_by_day(t) -> DataFrame:
    """Bytes of public uploads by half-open UTC day; 0 where none."""
    rows = t.events.join(t.customer.select("c_custkey"), F.col("c_custkey") == F.col("user_id"), "left_semi")
    own = F.when(F.col("event_type").like("p%"), F.col("value"))
    total = F.coalesce(F.sum(own), F.lit(0.0))
    return rows.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg((total > 0).alias("any_bytes"), F.count(own).alias("uploads"), F.round(total, 4).alias("bytes"))


@query("""
SELECT user_id, count(*)::BIGINT AS held, count(CASE WHEN event_type = 'signup' THEN 1 END)::BIGINT AS uploads, count(CASE WHEN event_type NOT IN ('error', 'purchase') THEN 1 END)::BIGINT AS in_flight,
count(DISTINCT date_trunc('day', ts))::BIGINT AS days FROM events GROUP BY user_id
""")
def quota_counts(t) -> DataFrame:
    """All counts that admission compares with its quotas, in one pass."""
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("held"),
        F.count_if(F.col("event_type") == "signup").alias("uploads"),
        F.count_if(~F.col("event_type").isin("error", "purchase")).alias("in_flight"),
        F.countDistinct(F.date_trunc("day", "ts")).alias("days"),
    )


@query("""
SELECT user_id, event_id, event_type AS stage, ts AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x
WHERE rn = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)
""")
def latest_stage_open(t) -> DataFrame:
    """The latest stage of every run without a terminal one."""
    closed = t.events.where("event_type = 'error' AND value > 100").select("user_id")
    latest = t.events.join(closed, "user_id", "left_anti").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return latest.select("user_id", "m.event_id", F.col("m.event_type").alias("stage"), F.col("m.ts").alias("at"))


@query("""
SELECT user_id, CASE WHEN last_at < TIMESTAMP '2024-01-28' THEN 'stale' WHEN n_error = 0 THEN 'unheld' WHEN last_at < TIMESTAMP '2024-01-30' THEN 'overdue' ELSE 'live' END AS verdict
FROM (SELECT user_id, max(ts) AS last_at, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_error FROM events GROUP BY user_id) x
""")
def recovery_decision(t) -> DataFrame:
    """What recovery does with each open run, by the age of its last progress and who holds it."""
    runs = t.events.groupBy("user_id").agg(F.max("ts").alias("last_at"), F.count_if(F.col("event_type") == "error").alias("n_error"))
    before = lambda day: F.col("last_at") < F.lit(day).cast("timestamp_ntz")
    return runs.select("user_id", F.when(before("2024-01-28"), "stale").when(F.col("n_error") == 0, "unheld").when(before("2024-01-30"), "overdue").otherwise("live").alias("verdict"))


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey AS run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM orders WHERE o_orderstatus <> 'P') x WHERE rn = 1
""")
def reuse_lookup(t) -> DataFrame:
    """The newest run that did not fail for each identity."""
    best = t.orders.where("o_orderstatus <> 'P'").groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return best.select("o_custkey", "o_orderpriority", F.col("m.o_orderkey").alias("run"))


@query("""
SELECT k FROM (SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events UNION SELECT doc_id FROM documents) x WHERE k NOT IN (SELECT c_custkey FROM customer)
""")
def unlisted_union_distinct(t) -> DataFrame:
    """Keys that any table names but the listing does not hold."""
    named = t.orders.select(F.col("o_custkey").alias("k")).union(t.events.select("user_id")).union(t.documents.select("doc_id"))
    return named.where("k IS NOT NULL").distinct().join(t.customer.select(F.col("c_custkey").alias("k")), "k", "left_anti")


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 UNION SELECT p_partkey FROM part WHERE p_size = 1")
def held_documents_union(t) -> DataFrame:
    a = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("k"))
    return a.union(t.supplier.where("s_acctbal < 0").select("s_suppkey")).union(t.part.where("p_size = 1").select("p_partkey")).distinct()


@query("""
SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')
OR EXISTS (SELECT 1 FROM documents WHERE doc_id = p_partkey) OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)
""")
def still_used_union_semi(t) -> DataFrame:
    """Files that some table still refers to: one semi join against all references."""
    refs = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).union(t.documents.select("doc_id")).union(t.supplier.select("s_suppkey"))
    return t.part.select("p_partkey").join(refs, F.col("k") == F.col("p_partkey"), "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def purge_rewrite(t) -> DataFrame:
    """What a cascading purge of expired owners leaves: an anti join."""
    gone = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(gone, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND n_chars > 3600")
def orphan_census(t) -> DataFrame:
    """Files that no row names and that are past the grace."""
    return t.documents.where("n_chars > 3600").select("doc_id", "n_chars").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("""
SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-25' THEN TIMESTAMP '2024-01-25' ELSE ts END AS created_at,
CASE WHEN ts > TIMESTAMP '2024-01-25' THEN TIMESTAMP '2024-01-25' ELSE ts END + INTERVAL 2 HOUR AS expires_at FROM events WHERE event_type = 'view'
""")
def reanchored_visits(t) -> DataFrame:
    """Visits from the future begin now and keep their length."""
    start = F.least("ts", F.lit("2024-01-25").cast("timestamp_ntz"))
    return t.events.where("event_type = 'view'").select("event_id", start.alias("created_at"), (start + F.expr("INTERVAL 2 HOURS")).alias("expires_at"))


@query("""
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')::BIGINT AS open_runs, (SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))::BIGINT AS unowned,
(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')::BIGINT AS reviews
""")
def owner_guard(t) -> DataFrame:
    """Three scalar counts in one row."""
    a = t.orders.where("o_orderstatus = 'O'").agg(F.count("*").alias("open_runs"))
    b = t.customer.join(t.orders.select("o_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("unowned"))
    return a.join(b, F.lit(True)).join(t.lineitem.where("l_returnflag = 'R'").agg(F.count("*").alias("reviews")), F.lit(True))


@query("""
SELECT o_custkey, o_orderpriority, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS runs, count(*)::BIGINT AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2
""")
def golden_runs_grouped(t) -> DataFrame:
    """Runs of the wanted identities, grouped by document and options."""
    rows = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    listed = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")))
    return rows.groupBy("o_custkey", "o_orderpriority").agg(listed.alias("runs"), F.count("*").alias("n"))


@query("SELECT text AS content, min(doc_id) AS first_holder, count(*)::BIGINT AS holders FROM documents GROUP BY text")
def first_holder(t) -> DataFrame:
    """The first holder of each content; the content is compared by its digest, the text rides along once."""
    rows = t.documents.select("doc_id", "text", F.sha2("text", 256).alias("k"))
    return rows.groupBy("k").agg(F.first("text").alias("content"), F.min("doc_id").alias("first_holder"), F.count("*").alias("holders")).select("content", "first_holder", "holders")


@query("""
SELECT c_mktsegment, count(DISTINCT o_orderkey)::BIGINT AS runs, count(DISTINCT l_suppkey)::BIGINT AS members FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY c_mktsegment
""")
def runs_by_source(t) -> DataFrame:
    """Four tables joined, distinct counts of both ends."""
    rows = (
        t.lineitem.select("l_orderkey", "l_suppkey")
        .join(t.supplier.select("s_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer.select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    )
    return rows.groupBy("c_mktsegment").agg(F.countDistinct("o_orderkey").alias("runs"), F.countDistinct("l_suppkey").alias("members"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS n FROM {n}" for n in ("customer", "orders", "lineitem", "events", "documents", "labels")))
def table_row_counts(t) -> DataFrame:
    """Row counts for a parity check between stores."""
    out = None
    for n in ("customer", "orders", "lineitem", "events", "documents", "labels"):
        one = getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id, event_type FROM events WHERE NOT (event_type IN ('click', 'purchase', 'signup', 'view') AND value >= 0) ORDER BY event_id LIMIT 20")
def vocabulary_violations(t) -> DataFrame:
    """The first 20 rows that break a closed vocabulary."""
    return t.events.where("NOT (event_type IN ('click', 'purchase', 'signup', 'view') AND value >= 0)").select("event_id", "event_type").orderBy("event_id").limit(20)


@query("""
SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS run FROM orders LEFT JOIN part ON p_partkey = o_custkey
WHERE o_orderstatus = 'F' AND (p_brand IS NULL OR p_brand <> 'Brand#1') AND o_orderpriority NOT LIKE '%LOW%' GROUP BY o_custkey
""")
def newest_complete_run(t) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'F' AND o_orderpriority NOT LIKE '%LOW%'")
    rows = rows.join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("o_custkey"), "left").where("p_brand IS NULL OR p_brand <> 'Brand#1'")
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"))


@query("""
SELECT l_orderkey, l_linenumber, coalesce(nullif(s_name, ''), nullif(l_returnflag, ''), 'heading') AS label FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0
""")
def span_label_fallback(t) -> DataFrame:
    """Number, else the cited label, else the heading; empty counts as missing."""
    named = t.supplier.where("s_acctbal > 0").select("s_suppkey", "s_name")
    joined = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").join(named, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", F.coalesce(F.nullif("s_name", F.lit("")), F.nullif("l_returnflag", F.lit("")), F.lit("heading")).alias("label"))


@query("SELECT quality AS version, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def documents_per_version(t) -> DataFrame:
    """NULL is a group of its own."""
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").groupBy(F.col("quality").alias("version")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, coalesce(max(l_shipdate), o_orderdate) AS progress FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'F'
WHERE o_orderstatus <> 'F' GROUP BY o_orderkey, o_orderdate HAVING coalesce(max(l_shipdate), o_orderdate) < TIMESTAMP '1998-01-01'
""")
def open_runs_progress(t) -> DataFrame:
    """Open runs whose last progress, or creation, is older than a bound."""
    last = t.lineitem.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("at"))
    rows = t.orders.where("o_orderstatus <> 'F'").join(last, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("at", "o_orderdate").alias("progress")).where(F.col("progress") < F.lit("1998-01-01").cast("timestamp_ntz"))


@query("SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_shipdate > o_orderdate AND l_returnflag = 'A'")
def distinct_exact_quotes(t) -> DataFrame:
    rows = t.lineitem.where("l_returnflag = 'A'").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate > o_orderdate")
    return rows.join(t.customer.select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("o_custkey", "l_partkey").distinct()


@query("SELECT p_type, min_by(p_partkey, (p_size, p_partkey)) AS guidance FROM part WHERE p_brand IS NULL OR p_brand <> 'Brand#5' GROUP BY p_type")
def guidance_by_hash(t) -> DataFrame:
    """The first visible guidance of each text, in creation order."""
    return t.part.where("p_brand IS NULL OR p_brand <> 'Brand#5'").groupBy("p_type").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("guidance"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) x WHERE before IS NULL OR before <> event_type
""")
def review_append(t) -> DataFrame:
    """An append that repeats the standing verdict writes nothing."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("before", F.lag("event_type").over(w)).where("before IS NULL OR before <> event_type")
    return rows.select("user_id", "event_id", "event_type")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def outcome_pivot_base(t) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
