from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexquarry.operators.components import connected_components
from lexquarry.operators.lineage import depths
from lexquarry.operators.ranking import global_rank
from lexquarry.operators.stateful import Admission, FloodShaping, SlidingWindow, sliding_admission
from lexquarry.streaming.windows import admitted, event_stream, hourly


def test_refused_events_do_not_count():
    w = SlidingWindow(2, 10)
    assert [w.take(t) for t in (0, 1, 2, 9, 10, 11)] == [(True, 0), (True, 0), (False, 8), (False, 1), (True, 0), (True, 0)]


def test_flood_windows_begin_with_their_first_record():
    f = FloodShaping(2, 60)
    assert [f.filter(t) for t in (5, 6, 7, 64, 65, 66)] == [0, 0, None, None, 2, 0]


def test_weighted_queue_lets_the_second_through():
    jobs = [(k, 0, 10, 0) for k in range(6)] + [(9, 0, 10, 1)]
    order = [j for j, _, _ in Admission(4).simulate(jobs)]
    assert order.index(9) == 4 and [j for j, _, _ in Admission(fifo=True).simulate(jobs)][-1] == 9


def test_sliding_admission_equals_a_plain_loop(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = {r.event_id: r.accepted for r in sliding_admission(events, 3, 3600).collect()}
    windows, want = {}, {}
    for r in sorted(events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).collect(), key=lambda r: (r.at, r.event_id)):
        want[r.event_id] = windows.setdefault(r.user_id, SlidingWindow(3, 3_600_000_000)).take(r.at)[0]
    assert got == want


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_lineage_and_ranks(spark):
    rows = depths(spark.createDataFrame([(k, k - 1) for k in range(1, 40)], "k bigint, up bigint")).collect()
    assert {r.k: r.depth for r in rows} == {k: k for k in range(1, 40)} and {r.root for r in rows} == {0}
    looped = depths(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)], "k bigint, up bigint")).collect()
    assert sorted((r.k, r.root, r.depth) for r in looped) == [(1, None, None), (2, None, None), (3, None, None), (4, None, None), (5, 6, 1)]
    ranked = global_rank(spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(50))), ["x", "id"], "rn").orderBy("x", "id").collect()
    assert [r.rn for r in ranked] == list(range(1, 1001))


def test_streaming_twins(spark, sf_dir):
    def drain(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = drain(hourly(event_stream(spark, sf_dir)), "complete", "hours")
    assert hours.agg(F.sum("n")).first()[0] == events.count()
    got = {r.event_id: r.accepted for r in drain(admitted(event_stream(spark, sf_dir), 3, 3600), "append", "admitted").collect()}
    assert got == {r.event_id: r.accepted for r in sliding_admission(events, 3, 3600).collect()}
