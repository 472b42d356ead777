"""Verdicts over recorded runs, flags, routing, retention and layout, over tables derived from orders, lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.session import dealt, ensure_checkpoint_dir

from .base import query

# ---------------------------------------------------------------- runs and goldens

#: A run per order: its stage and reason; a finding per line: its status, source, section and whether its quote was located.
RUN_STAGE = "CASE o_orderkey % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'unresolved' WHEN 3 THEN 'running' ELSE 'complete' END"
RUN_REASON = "CASE o_orderkey % 9 WHEN 0 THEN 'model_error' WHEN 1 THEN 'citations_unverified' WHEN 2 THEN 'nothing_found' END"
STATUS = "CASE l_partkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'risk' ELSE 'pass' END"
SOURCE = "CASE l_suppkey % 4 WHEN 0 THEN 'computed_days' WHEN 1 THEN 'reference_check' ELSE 'model_hint' END"
LOCATED = "l_partkey % 3 > 0 AND l_partkey % 5 > 0"
#: Statuses that assert the point, and sources by which code lowers one.
ASSERTING = ("pass", "needs_review", "risk")
LOWERED_BY_CODE = ("reference_check", "position_check")
_SQL_RUNS = f"""
r AS (SELECT o_orderkey AS run_id, {RUN_STAGE} AS stage, {RUN_REASON} AS reason FROM orders),
f AS (SELECT l_orderkey AS run_id, l_linenumber AS place, {STATUS} AS status, {SOURCE} AS source, {LOCATED} AS located, l_suppkey % 10 AS section, l_partkey AS part FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)
"""


def runs(t) -> DataFrame:
    return t.orders.selectExpr("o_orderkey AS run_id", f"{RUN_STAGE} AS stage", f"{RUN_REASON} AS reason")


def findings(t) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    rows = t.lineitem.withColumn("first", first).where("first = 1")
    return rows.selectExpr("l_orderkey AS run_id", "l_linenumber AS place", f"{STATUS} AS status", f"{SOURCE} AS source", f"{LOCATED} AS located", "l_suppkey % 10 AS section", "l_partkey AS part")


@query(f"""
WITH {_SQL_RUNS}, a AS (SELECT run_id, min(CASE WHEN located AND status <> 'missing' THEN place END) AS answer, min(CASE WHEN status = 'missing' THEN place END) AS absent FROM f GROUP BY run_id)
SELECT r.run_id, CASE WHEN stage = 'failed' THEN 'failed' WHEN stage = 'unresolved' AND reason = 'citations_unverified' THEN 'withheld' WHEN stage = 'unresolved' THEN 'not_found'
  WHEN stage <> 'complete' THEN 'in_progress' WHEN answer IS NOT NULL THEN 'answered' WHEN absent IS NOT NULL THEN 'not_found' ELSE 'withheld' END AS outcome,
  CASE WHEN stage = 'complete' THEN coalesce(answer, absent) END AS place, reason FROM r LEFT JOIN a USING (run_id)
""")
def batch_values(t) -> DataFrame:
    """Each run's value: its first finding with a located quote, else its first 'missing', or why there is none."""
    place = lambda test: F.min(F.when(F.expr(test), F.col("place")))
    first = findings(t).groupBy("run_id").agg(place("located AND status <> 'missing'").alias("answer"), place("status = 'missing'").alias("absent"))
    stage, done = F.col("stage"), F.col("stage") == "complete"
    outcome = F.when(stage == "failed", "failed").when((stage == "unresolved") & (F.col("reason") == "citations_unverified"), "withheld").when(stage == "unresolved", "not_found")
    outcome = outcome.when(~done, "in_progress").when(F.col("answer").isNotNull(), "answered").when(F.col("absent").isNotNull(), "not_found").otherwise("withheld")
    return runs(t).join(first, "run_id", "left").select("run_id", outcome.alias("outcome"), F.when(done, F.coalesce("answer", "absent")).alias("place"), "reason")


#: A golden per run: absent or present, in which section, and with which status if it names one.
GOLDEN_KIND = "CASE WHEN o_custkey % 4 = 0 THEN 'absent' ELSE 'present' END"
GOLDEN_STATUS = "CASE o_custkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'needs_review' END"
_SQL_JUDGED = f"""
{_SQL_RUNS}, g AS (SELECT o_orderkey AS run_id, {GOLDEN_KIND} AS kind, o_custkey % 10 AS section, {GOLDEN_STATUS} AS status, o_custkey % 6 AS task FROM orders),
c AS (SELECT g.run_id, coalesce(bool_or(f.status IN {ASSERTING}), FALSE) AS asserts, count(f.place) AS findings, coalesce(bool_and(f.status = 'missing'), FALSE) AS all_missing,
  count(CASE WHEN carries THEN 1 END) AS carriers, coalesce(bool_or(carries AND f.status = g.status), FALSE) AS right_, coalesce(bool_or(carries AND f.status <> g.status), FALSE) AS wrong,
  coalesce(bool_or(carries AND f.source NOT IN {LOWERED_BY_CODE}), FALSE) AS own
  FROM g LEFT JOIN (SELECT f.*, located AND f.status IN {ASSERTING} AND f.section % 5 = g.section % 5 AS carries FROM f JOIN g USING (run_id)) f ON f.run_id = g.run_id GROUP BY g.run_id),
judged AS (SELECT run_id, task, CASE WHEN stage = 'failed' THEN 'fail: run failed' WHEN stage = 'running' THEN 'missing: in progress'
  WHEN kind = 'absent' AND stage = 'unresolved' THEN 'pass: nothing asserted' WHEN kind = 'absent' AND asserts THEN 'fail: asserted' WHEN kind = 'absent' THEN 'pass: not found'
  WHEN stage = 'unresolved' THEN 'fail: withheld' WHEN status IS NOT NULL AND wrong AND right_ THEN 'fail: decided both' WHEN status IS NOT NULL AND wrong THEN 'fail: other status'
  WHEN carriers > 0 AND own THEN 'pass: cited' WHEN carriers > 0 THEN 'pass: cited, lowered' WHEN findings > 0 AND all_missing THEN 'fail: answered not found' ELSE 'fail: no citation' END AS verdict
  FROM g JOIN r USING (run_id) JOIN c USING (run_id))
"""


@query(f"WITH {_SQL_JUDGED} SELECT * FROM judged")
def golden_judgement(t) -> DataFrame:
    """Each golden against its run: a present one needs a verified citation in its section and, if named, its status on all that cite it."""
    g = t.orders.selectExpr("o_orderkey AS run_id", f"{GOLDEN_KIND} AS kind", "o_custkey % 10 AS want", f"{GOLDEN_STATUS} AS named", "o_custkey % 6 AS task")
    f = findings(t).join(g, "run_id").withColumn("carries", F.col("located") & F.col("status").isin(*ASSERTING) & (F.col("section") % 5 == F.col("want") % 5))
    any_of = lambda test, name: F.coalesce(F.bool_or(F.expr(test)), F.lit(False)).alias(name)
    facts = f.groupBy("run_id").agg(
        any_of(f"status IN {ASSERTING}", "asserts"),
        F.count("*").alias("findings"),
        F.bool_and(F.col("status") == "missing").alias("all_missing"),
        F.count_if("carries").alias("carriers"),
        any_of("carries AND status = named", "right"),
        any_of("carries AND status <> named", "wrong"),
        any_of(f"carries AND source NOT IN {LOWERED_BY_CODE}", "own"),
    )
    rows = g.join(runs(t), "run_id").join(facts, "run_id", "left").na.fill(False, ["asserts", "all_missing", "right", "wrong", "own"]).na.fill(0, ["findings", "carriers"])
    absent, unresolved, names = F.col("kind") == "absent", F.col("stage") == "unresolved", F.col("named").isNotNull()
    verdict = F.when(F.col("stage") == "failed", "fail: run failed").when(F.col("stage") == "running", "missing: in progress")
    verdict = verdict.when(absent & unresolved, "pass: nothing asserted").when(absent & F.col("asserts"), "fail: asserted").when(absent, "pass: not found").when(unresolved, "fail: withheld")
    verdict = verdict.when(names & F.col("wrong") & F.col("right"), "fail: decided both").when(names & F.col("wrong"), "fail: other status")
    verdict = verdict.when((F.col("carriers") > 0) & F.col("own"), "pass: cited").when(F.col("carriers") > 0, "pass: cited, lowered")
    verdict = verdict.when((F.col("findings") > 0) & F.col("all_missing"), "fail: answered not found").otherwise("fail: no citation")
    return rows.select("run_id", "task", verdict.alias("verdict"))


@query(f"""
WITH {_SQL_JUDGED}, s AS (SELECT task, run_id, verdict LIKE 'pass%' AS base, verdict NOT LIKE 'missing%' AS base_done, (verdict LIKE 'pass%' AND run_id % 13 > 0) OR (task > 2 AND run_id % 11 = 0) AS head, verdict NOT LIKE 'missing%' AND NOT (task = 5 AND run_id % 17 = 0) AS head_done FROM judged)
SELECT task, count(CASE WHEN base_done THEN 1 END)::BIGINT AS base_recorded, count(CASE WHEN head_done THEN 1 END)::BIGINT AS head_recorded, count(CASE WHEN base_done AND head_done AND head AND NOT base THEN 1 END)::BIGINT AS better,
  count(CASE WHEN base_done AND head_done AND base AND NOT head THEN 1 END)::BIGINT AS worse,
  CASE WHEN count(CASE WHEN head_done THEN 1 END) = 0 OR count(CASE WHEN head_done THEN 1 END) < count(CASE WHEN base_done THEN 1 END) THEN 'not measured' WHEN count(CASE WHEN base_done AND head_done AND base AND NOT head THEN 1 END) > 0 THEN 'not routed' ELSE 'may be routed' END AS routing,
  CASE WHEN count(CASE WHEN base_done AND head_done AND head AND NOT base THEN 1 END) = 0 THEN 'not kept' WHEN count(CASE WHEN base_done AND head_done AND base AND NOT head THEN 1 END) > 0 THEN 'kept if accepted' ELSE 'kept' END AS prompt FROM s GROUP BY task
""")
def prompt_verdicts(t) -> DataFrame:
    """Per task, a candidate against the base: better and worse goldens, whether it may be routed and whether its prompt is kept."""
    judged = golden_judgement(t)
    passes, recorded = F.col("verdict").startswith("pass"), ~F.col("verdict").startswith("missing")
    head = (passes & (F.col("run_id") % 13 > 0)) | ((F.col("task") > 2) & (F.col("run_id") % 11 == 0))
    s = judged.select("task", passes.alias("base"), recorded.alias("base_done"), head.alias("head"), (recorded & ~((F.col("task") == 5) & (F.col("run_id") % 17 == 0))).alias("head_done"))
    both = F.col("base_done") & F.col("head_done")
    c = s.groupBy("task").agg(
        F.count_if("base_done").alias("base_recorded"),
        F.count_if("head_done").alias("head_recorded"),
        F.count_if(both & F.col("head") & ~F.col("base")).alias("better"),
        F.count_if(both & F.col("base") & ~F.col("head")).alias("worse"),
    )
    routing = F.when((F.col("head_recorded") == 0) | (F.col("head_recorded") < F.col("base_recorded")), "not measured").when(F.col("worse") > 0, "not routed").otherwise("may be routed")
    prompt = F.when(F.col("better") == 0, "not kept").when(F.col("worse") > 0, "kept if accepted").otherwise("kept")
    return c.withColumn("routing", routing).withColumn("prompt", prompt)


@query(f"""
WITH {_SQL_RUNS} SELECT run_id, place, CASE WHEN located OR status = 'missing' THEN 'finding' ELSE 'withheld' END AS kind,
  CASE WHEN NOT (located OR status = 'missing') THEN 'no quote of it was found' WHEN status <> 'pass' THEN status ELSE source END AS why
FROM f WHERE NOT (located OR status = 'missing') OR status <> 'pass' OR source = 'reference_check'
""")
def memo_flags(t) -> DataFrame:
    """Every flag of a memo: findings that are no pass or that code raised something against, then all withheld proposals."""
    f = findings(t).withColumn("stands", F.expr("located OR status = 'missing'"))
    flagged = f.where("stands AND (status <> 'pass' OR source = 'reference_check')").select("run_id", "place", F.lit("finding").alias("kind"), F.when(F.col("status") != "pass", F.col("status")).otherwise(F.col("source")).alias("why"))
    withheld = f.where("NOT stands").select("run_id", "place", F.lit("withheld").alias("kind"), F.lit("no quote of it was found").alias("why"))
    return flagged.unionByName(withheld)


MODE = "CASE o_orderkey % 5 WHEN 0 THEN 'opening_fallback' WHEN 1 THEN NULL ELSE 'ranked' END"


@query(f"""
WITH c AS (SELECT l_orderkey AS run_id, count(*) AS read_, count(CASE WHEN l_partkey % 4 = 0 THEN 1 END) AS linked FROM lineitem GROUP BY 1)
SELECT o_orderkey AS run_id, coalesce(read_, 0)::BIGINT AS read, 10 + o_custkey % 20 AS total, CASE WHEN {MODE} = 'opening_fallback' THEN 'opening sections' WHEN {MODE} IS NULL THEN 'not recorded'
  WHEN coalesce(linked, 0) > 0 THEN (read_ - linked) || ' chosen, ' || linked || ' linked' ELSE 'chosen' END AS how FROM orders LEFT JOIN c ON c.run_id = o_orderkey
""")
def reading_lines(t) -> DataFrame:
    """How many of a document's sections a run read, and how they were chosen."""
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("read"), F.count_if(F.col("l_partkey") % 4 == 0).alias("linked"))
    o = t.orders.selectExpr("o_orderkey AS run_id", "10 + o_custkey % 20 AS total", f"{MODE} AS mode").join(c, "run_id", "left")
    how = F.when(F.col("mode") == "opening_fallback", "opening sections").when(F.col("mode").isNull(), "not recorded")
    how = how.when(F.coalesce("linked", F.lit(0)) > 0, F.concat((F.col("read") - F.col("linked")).cast("string"), F.lit(" chosen, "), F.col("linked").cast("string"), F.lit(" linked"))).otherwise("chosen")
    return o.select("run_id", F.coalesce("read", F.lit(0)).alias("read"), "total", how.alias("how"))


# ---------------------------------------------------------------- providers, routing, quotas


@query("""
WITH m AS (SELECT sha256(conv_id::VARCHAR || chr(31) || coalesce(text, '')) AS key, conv_id, turn, text FROM conversations WHERE role = 'user'),
rec AS (SELECT key, 'recorded ' || min(turn) AS answer FROM m WHERE conv_id % 3 > 0 GROUP BY key)
SELECT conv_id, turn, coalesce(answer, 'not recorded') AS answer FROM m LEFT JOIN rec USING (key)
""")
def replay_lookup(t) -> DataFrame:
    """A replay provider: each request's recorded answer by the digest of its two messages, or that there is none."""
    m = t.conversations.where("role = 'user'").withColumn("key", F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit("\x1f"), F.coalesce("text", F.lit(""))).cast("binary"), 256))
    recorded = m.where("conv_id % 3 > 0").groupBy("key").agg(F.concat(F.lit("recorded "), F.min("turn").cast("string")).alias("answer"))
    return m.join(recorded, "key", "left").select("conv_id", "turn", F.coalesce("answer", F.lit("not recorded")).alias("answer"))


ROUTES = (("click", "small"), ("purchase", "large"))


@query(f"""
WITH route(task, model) AS (VALUES {", ".join(map(str, ROUTES))})
SELECT event_type AS task, coalesce(model, 'default') AS model, count(*)::BIGINT AS runs FROM events LEFT JOIN route ON task = event_type GROUP BY 1, 2
""")
def model_routing(t) -> DataFrame:
    """Runs by task and the model its route names; tasks without a route go to the default."""
    model = F.create_map(*[F.lit(x) for r in ROUTES for x in r])[F.col("event_type")]
    return t.events.groupBy(F.col("event_type").alias("task"), F.coalesce(model, F.lit("default")).alias("model")).agg(F.count("*").alias("runs"))


QUOTAS = (("requests", 40, "count"), ("value", 2000, "sum"), ("kinds", 4, "distinct"))


@query(f"""
WITH u AS (SELECT user_id, count(*)::DOUBLE AS requests, coalesce(sum(value), 0) AS value, count(DISTINCT event_type)::DOUBLE AS kinds FROM events GROUP BY 1),
m AS (UNPIVOT u ON requests, value, kinds INTO NAME quota VALUE used), q(quota, most, kind) AS (VALUES {", ".join(map(str, QUOTAS))})
SELECT user_id, quota, round(used, 4) AS used, used >= most AS refused FROM m JOIN q USING (quota) WHERE used >= most
""")
def quota_rules(t) -> DataFrame:
    """Quotas as rows: what each counts and its limit; the users that reach one and are refused."""
    u = t.events.groupBy("user_id").agg(F.count("*").cast("double").alias("requests"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"), F.count_distinct("event_type").cast("double").alias("kinds"))
    m = u.unpivot(["user_id"], ["requests", "value", "kinds"], "quota", "used")
    q = t.spark.createDataFrame(QUOTAS, "quota string, most int, kind string")
    return m.join(F.broadcast(q), "quota").where("used >= most").select("user_id", "quota", F.round("used", 4).alias("used"), F.lit(True).alias("refused"))


# ---------------------------------------------------------------- retention and liveness


@query("""
WITH s AS (SELECT user_id, event_id, 1 + event_id % 97 AS size FROM events), r AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS newer, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM s)
SELECT user_id, count(*)::BIGINT AS kept, sum(size)::BIGINT AS bytes FROM r WHERE newer <= 400 OR n = 1 GROUP BY user_id
""")
def segment_retention(t) -> DataFrame:
    """Of each owner's segments the newest that fit the budget together; the newest stays whatever its size."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    r = t.events.select("user_id", "event_id", (1 + F.col("event_id") % 97).alias("size"))
    r = r.select("user_id", "size", F.sum("size").over(w).alias("newer"), F.row_number().over(w).alias("n")).where("newer <= 400 OR n = 1")
    return r.groupBy("user_id").agg(F.count("*").alias("kept"), F.sum("size").alias("bytes"))


@query("""
WITH o AS (SELECT o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'far' ELSE 'here' END AS host, o_custkey % 50 AS pid, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 's' || o_orderkey % 3 END AS started FROM orders),
p AS (SELECT c_custkey AS pid, 's' || c_custkey % 3 AS token FROM customer WHERE c_custkey < 40)
SELECT run_id, CASE WHEN host IS NULL OR host <> 'here' THEN 'unknown' WHEN token IS NULL THEN 'gone' WHEN token = started THEN 'alive' WHEN started <> '' THEN 'gone' ELSE 'unknown' END AS owner FROM o LEFT JOIN p USING (pid)
""")
def owner_liveness(t) -> DataFrame:
    """Whether a run's owner is alive, gone or unknown, by host, process and start token: other hosts are never gone."""
    o = t.orders.selectExpr(
        "o_orderkey AS run_id", "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'far' ELSE 'here' END AS host", "o_custkey % 50 AS pid", "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('s', CAST(o_orderkey % 3 AS STRING)) END AS started"
    )
    p = t.customer.where("c_custkey < 40").selectExpr("c_custkey AS pid", "concat('s', CAST(c_custkey % 3 AS STRING)) AS token")
    owner = F.when(F.col("host").isNull() | (F.col("host") != "here"), "unknown").when(F.col("token").isNull(), "gone").when(F.col("token") == F.col("started"), "alive").when(F.col("started") != "", "gone").otherwise("unknown")
    return o.join(p, "pid", "left").select("run_id", owner.alias("owner"))


# ---------------------------------------------------------------- styles and glyphs


@query("""
WITH RECURSIVE s AS (SELECT p_partkey AS style, CASE WHEN p_partkey % 10 > 0 THEN p_partkey - 1 END AS based_on, CASE WHEN p_size % 3 = 0 THEN p_size END AS size_, CASE WHEN p_size % 4 = 0 THEN p_brand END AS font FROM part),
c AS (SELECT style, based_on, size_, font, 0 AS depth FROM s UNION ALL SELECT c.style, s.based_on, coalesce(c.size_, s.size_), coalesce(c.font, s.font), depth + 1 FROM c JOIN s ON s.style = c.based_on)
SELECT style, size_ AS size, font, depth::INT AS depth FROM c WHERE based_on IS NULL
""")
def style_inheritance(t) -> DataFrame:
    """Each style with what it inherits: the nearest value on its chain, by doubling the distance every step.

    After as many steps as the number of styles has binary digits only chains without an end are open: those give no row.
    """
    ensure_checkpoint_dir(t.spark)
    s = t.part.selectExpr("p_partkey AS style", "CASE WHEN p_partkey % 10 > 0 THEN p_partkey - 1 END AS based_on", "CASE WHEN p_size % 3 = 0 THEN p_size END AS size", "CASE WHEN p_size % 4 = 0 THEN p_brand END AS font")
    s = s.withColumn("depth", F.when(F.col("based_on").isNotNull(), 1).otherwise(0)).checkpoint()
    for _ in range(int(s.count()).bit_length()):
        if s.where("based_on IS NOT NULL").isEmpty():
            break
        up = s.select(F.col("style").alias("based_on"), F.col("based_on").alias("above"), F.col("size").alias("up_size"), F.col("font").alias("up_font"), F.col("depth").alias("up_depth"))
        s = s.join(up, "based_on", "left").select("style", F.col("above").alias("based_on"), F.coalesce("size", "up_size").alias("size"), F.coalesce("font", "up_font").alias("font"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth")).checkpoint()
    return s.where("based_on IS NULL").select("style", "size", "font", "depth")


#: Strings drawn on a page: a page per order, with start, end, baseline, height and width of a blank.
_DRAWN = (
    "l_orderkey AS page",
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n",
    "CAST(l_partkey % 40 AS DOUBLE) AS tx",
    "CAST(l_partkey % 40 + 1 + l_suppkey % 9 AS DOUBLE) AS dx",
    "CAST(l_suppkey % 3 * 12 AS DOUBLE) AS ty",
    "CAST(10 AS DOUBLE) AS height",
    "CAST(2 AS DOUBLE) AS blank",
    "concat('w', CAST(l_suppkey % 30 AS STRING)) AS text",
)


@query(f"""
WITH d AS (SELECT {", ".join(_DRAWN)} FROM lineitem),
b AS (SELECT *, CASE WHEN n = 1 OR abs(ty - lag(ty) OVER w) > height OR lag(dx) OVER w - tx > 5 * blank THEN 1 ELSE 0 END AS new_ FROM d WINDOW w AS (PARTITION BY page ORDER BY n)),
g AS (SELECT *, sum(new_) OVER (PARTITION BY page ORDER BY n) AS grp, tx < lag(tx) OVER w - 0.01 AS back FROM b WINDOW w AS (PARTITION BY page ORDER BY n)),
o AS (SELECT *, CASE WHEN max(CASE WHEN back AND new_ = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page, grp) = 1 THEN tx ELSE 0 END AS drawn FROM g),
e AS (SELECT *, lag(dx) OVER (PARTITION BY page, grp ORDER BY drawn, n) AS before_, row_number() OVER (PARTITION BY page, grp ORDER BY drawn, n) AS i FROM o)
SELECT page, grp::BIGINT AS line, string_agg(CASE WHEN before_ IS NULL OR tx <= before_ THEN '' ELSE repeat(' ', round_even((tx - before_) / blank, 0)::INT) END || text, '' ORDER BY i) AS text FROM e GROUP BY page, grp
""")
def text_groups(t) -> DataFrame:
    """Drawn strings as lines: a new one where the baseline moves or the text jumps back; out of order ones by place; gaps as blanks."""
    d = dealt(t.lineitem.selectExpr(*_DRAWN), "page")
    w = Window.partitionBy("page").orderBy("n")
    was = lambda c: F.lag(c).over(w)
    new = (F.col("n") == 1) | (F.abs(F.col("ty") - was("ty")) > F.col("height")) | (was("dx") - F.col("tx") > 5 * F.col("blank"))
    g = d.withColumn("new", new.cast("int")).withColumn("back", F.coalesce(F.col("tx") < was("tx") - 0.01, F.lit(False)))
    g = g.withColumn("line", F.sum("new").over(w))
    moved = F.max((F.col("back") & (F.col("new") == 0)).cast("int")).over(Window.partitionBy("page", "line"))
    g = g.withColumn("drawn", F.when(moved == 1, F.col("tx")).otherwise(0.0))
    inside = Window.partitionBy("page", "line").orderBy("drawn", "n")
    before = F.lag("dx").over(inside)
    gap = F.when(before.isNull() | (F.col("tx") <= before), 0).otherwise(F.rint((F.col("tx") - before) / F.col("blank"))).cast("int")
    e = g.select("page", "line", F.row_number().over(inside).alias("i"), F.concat(F.repeat(F.lit(" "), gap), "text").alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("i", "piece")))
    return e.groupBy("page", "line").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("text"))
