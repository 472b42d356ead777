"""Time and state: stage transitions, windows, quotas, staleness, queues, over the event stream as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.operators.stateful import admission_waits, lives, shape_flood, sliding_admission, wake_states

from .base import query


def _user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def _seconds(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("""
SELECT user_id, day, event_id FROM (SELECT user_id, event_id, date_trunc('day', ts)::DATE AS day, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM events) x WHERE rn <= 3
""")
def daily_quota_admit(t) -> DataFrame:
    """The first three of each key and half-open UTC day are admitted."""
    day = F.to_date("ts")
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    return t.events.withColumn("day", day).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("user_id", "day", "event_id")


@query("""
SELECT user_id, event_id, event_type, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS duration_us FROM events
""")
def stage_durations(t) -> DataFrame:
    """Each stage lasts until the next one of its run; the last has none."""
    rows = t.events.select("user_id", "event_id", "event_type", "ts", _seconds("ts").alias("us"))
    return rows.select("user_id", "event_id", "event_type", (F.lead("us").over(_user()) - F.col("us")).alias("duration_us"))


@query("""
SELECT user_id, event_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) x
WHERE before IS NOT NULL AND (before, event_type) NOT IN (('signup','view'),('view','click'),('view','view'),('click','purchase'),('click','view'),('purchase','view'),('click','error'),('view','error'),('error','view'))
""")
def illegal_transitions(t) -> DataFrame:
    """Stage changes that the state machine does not allow."""
    legal = {("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("click", "error"), ("view", "error"), ("error", "view")}
    allowed = F.lit(False)
    for a, b in sorted(legal):
        allowed = allowed | ((F.col("before") == a) & (F.col("event_type") == b))
    rows = t.events.withColumn("before", F.lag("event_type").over(_user())).where(F.col("before").isNotNull() & ~allowed)
    return rows.select("user_id", "event_id", "before", "event_type")


@query("""
SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR
""")
def stale_open(t) -> DataFrame:
    """Runs without progress for longer than the limit, by the record's own clock."""
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last_at"))
    now = t.events.agg(F.max("ts").alias("now"))
    return last.join(F.broadcast(now), F.col("last_at") < F.col("now") - F.expr("INTERVAL 12 HOURS")).select("user_id", "last_at")


@query("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS began, max(ts) AS ended, count(*)::BIGINT AS n FROM s GROUP BY user_id, session
""")
def sessionized_activity(t) -> DataFrame:
    """Gaps and islands: a session ends with a gap of more than six hours."""
    rows = t.events.select("user_id", "ts", "event_id", _seconds("ts").alias("us"))
    fresh = F.when(F.col("us") - F.lag("us").over(_user()) <= 6 * 3600 * 1_000_000, 0).otherwise(1)
    marked = rows.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(_user().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"))


@query()
def sliding_window_admission(t) -> DataFrame:
    """At most five accepted events in any six hours for each key; refused events do not count. Not expressible as a frame."""
    return sliding_admission(t.events, limit=5, width_seconds=6 * 3600)


@query()
def flood_shaping(t) -> DataFrame:
    """At most three records an hour of each user, windows anchored at their first record."""
    return shape_flood(t.events, limit=3, width_seconds=3600, key="user_id")


@query()
def admission_policies(t) -> DataFrame:
    """Waits under the weighted and the plain queue, by server; a server is one nation's orders."""
    orders = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    jobs = orders.select(
        F.col("c_nationkey").cast("bigint").alias("server"),
        F.col("o_orderkey").alias("job_id"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("arrival"),
        (F.lit(3600) + F.pmod(F.col("o_orderkey"), F.lit(7)) * 1800).cast("bigint").alias("service"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1).cast("bigint").alias("queue"),
    )
    both = None
    for name, fifo in (("weighted", False), ("fifo", True)):
        one = admission_waits(jobs, fifo).groupBy("server").agg(F.count("*").alias("jobs"), F.sum("wait").alias("waited"), F.max("wait").alias("longest"), F.max("depth").alias("deepest"))
        one = one.select(F.lit(name).alias("policy"), "*")
        both = one if both is None else both.unionByName(one)
    return both


@query("""
WITH p AS (SELECT event_type, ts AS moment, 1 AS d FROM events UNION ALL SELECT event_type, ts + INTERVAL 30 MINUTE, -1 FROM events),
c AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS n FROM p) SELECT event_type, max(n)::BIGINT AS most FROM c GROUP BY event_type
""")
def in_flight_peak(t) -> DataFrame:
    """Most requests in flight at once: starts and ends as a running sum, ends first."""
    starts = t.events.select("event_type", F.col("ts").alias("at"), F.lit(1).alias("d"))
    ends = t.events.select("event_type", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("at"), F.lit(-1).alias("d"))
    steps = starts.unionByName(ends).groupBy("event_type", "at", "d").agg(F.sum("d").alias("s"))
    w = Window.partitionBy("event_type").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("n", F.sum("s").over(w)).groupBy("event_type").agg(F.max("n").alias("most"))


@query("SELECT user_id, event_type, value, min(event_id) AS event_id, count(*)::BIGINT AS deliveries FROM events GROUP BY 1, 2, 3")
def exactly_once_identity(t) -> DataFrame:
    """Same inputs, same run: the first delivery of each identity."""
    return t.events.groupBy("user_id", "event_type", "value").agg(F.min("event_id").alias("event_id"), F.count("*").alias("deliveries"))


@query("""
SELECT event_id, user_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY + INTERVAL 60 SECOND
""")
def issued_in_future(t) -> DataFrame:
    """Rows later than a reference time by more than the tolerated skew of a minute."""
    now = t.events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY") + F.expr("INTERVAL 60 SECONDS")).alias("bound"))
    return t.events.join(F.broadcast(now), F.col("ts") > F.col("bound")).select("event_id", "user_id", "ts")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 AND event_type <> 'error'")
def replay_after(t) -> DataFrame:
    """What a subscriber that has seen event 500 still gets."""
    return t.events.where("event_id > 500 AND event_type <> 'error'").select("event_id", "user_id", "event_type")


@query("""
SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def hourly_windows(t) -> DataFrame:
    """Tumbling windows; the streaming twin is lexquarry.streaming.windows."""
    rows = t.events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("""
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT k, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM e GROUP BY k
""")
def props_by_key(t) -> DataFrame:
    """JSON text columns parsed with a declared schema."""
    return t.events.withColumn("k", F.from_json("props", "k bigint")["k"]).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""
SELECT o.o_orderkey, max(e.ts) AS as_of FROM (SELECT o_orderkey, o_custkey FROM orders) o JOIN events e ON e.user_id = o.o_custkey AND e.ts <= TIMESTAMP '2024-01-01' + to_hours((o.o_orderkey % 720)::INT) GROUP BY o.o_orderkey
""")
def as_of_start(t) -> DataFrame:
    """As-of lookup: the latest start reached at each run's own time.

    Both sides meet in one sorted stream by key; the last start seen is carried forward, so no pairs are made.
    """
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 720).cast("int"))
    asked = t.orders.select(F.col("o_custkey").alias("k"), at.alias("at"), F.lit(1).alias("kind"), "o_orderkey")
    starts = t.events.select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("o_orderkey"))
    w = Window.partitionBy("k").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = starts.unionByName(asked).withColumn("as_of", F.max(F.when(F.col("kind") == 0, F.col("at"))).over(w))
    return both.where("kind = 1 AND as_of IS NOT NULL").select("o_orderkey", "as_of")


TTL = 3 * 86_400


@query(f"""
WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, rn, us AS began FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, CASE WHEN o.us >= began + {TTL * 1_000_000} THEN o.us ELSE began END FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT user_id, began, began + {TTL * 1_000_000} AS expires, count(*)::BIGINT AS n, began + {TTL * 1_000_000} <= (SELECT max(us) FROM o) AS purged FROM w GROUP BY user_id, began
""")
def workspace_retention(t) -> DataFrame:
    """Lives of three days from their first event, and which of them are purged by the record's own clock."""
    now = t.events.agg(F.max(_seconds("ts")).alias("now"))
    per = lives(t.events, TTL).groupBy("user_id", "began").agg(F.count("*").alias("n")).withColumn("expires", F.col("began") + TTL * 1_000_000)
    return per.join(F.broadcast(now), F.col("expires").isNotNull()).select("user_id", "began", "expires", "n", (F.col("expires") <= F.col("now")).alias("purged"))


MODELS, AWAKE, TAKES, PER_DAY = 10, 3600, 1800, 4


@query(f"""
WITH RECURSIVE o AS (SELECT user_id % {MODELS} AS model, event_id, event_type = 'click' AS answer, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % {MODELS} ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT 0::BIGINT AS rn, model, NULL::BIGINT AS event_id, NULL::VARCHAR AS state, NULL::BIGINT AS heard, NULL::BIGINT AS started, NULL::BIGINT AS day, 0 AS spent FROM o WHERE rn = 1
UNION ALL SELECT rn, model, event_id, state, CASE WHEN answer THEN us ELSE heard1 END, CASE WHEN state = 'woken' THEN us ELSE started1 END,
  CASE WHEN state IN ('woken', 'limit') THEN us // 86400000000 ELSE day END, CASE WHEN state = 'woken' THEN spent1 + 1 WHEN state = 'limit' THEN spent1 ELSE spent END
FROM (SELECT *, CASE WHEN answer THEN NULL WHEN started1 IS NOT NULL THEN 'waking' WHEN heard1 IS NOT NULL AND us - heard1 < {AWAKE * 1_000_000} THEN 'awake' WHEN spent1 >= {PER_DAY} THEN 'limit' ELSE 'woken' END AS state
  FROM (SELECT o.*, w.day, w.spent, CASE WHEN w.started IS NOT NULL AND us >= w.started + {TAKES * 1_000_000} THEN greatest(coalesce(w.heard, 0), w.started + {TAKES * 1_000_000}) ELSE w.heard END AS heard1,
    CASE WHEN us >= w.started + {TAKES * 1_000_000} THEN NULL ELSE w.started END AS started1, CASE WHEN us // 86400000000 IS DISTINCT FROM w.day THEN 0 ELSE w.spent END AS spent1
    FROM w JOIN o ON o.model = w.model AND o.rn = w.rn + 1) a) b)
SELECT model, event_id, state FROM w WHERE state IS NOT NULL
""")
def model_wakes(t) -> DataFrame:
    """What each request to wake a model is told: woken, waking, awake, or that the day's wake-ups are spent."""
    return wake_states(t.events, MODELS, AWAKE, TAKES, PER_DAY)
