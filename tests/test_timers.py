"""Streams with timers and feedback against their batch twins, and fan-out under replay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexquarry.operators.stateful import Waker, lives, wake_states
from lexquarry.streaming import timers, windows


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The events in four files by time, so that a stream of one file a batch sees them in order."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    edges = [r.t for r in events.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.25, 0.5, 0.75]).alias("t")).collect()][0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for k, (low, high) in enumerate(zip([-1, *edges], [*edges, 2**62])):
        events.where((at > low) & (at <= high)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(spark, frame, name, tmp_path):
    timers.keep_state_on_disk(spark)
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def stream(spark, folder):
    return spark.readStream.schema(windows.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def test_purged_lives_equal_the_batch_twin(spark, parts, tmp_path):
    ttl = 86_400
    got = {(r.user_id, r.began_ms, r.n) for r in run(spark, timers.purged_lives(stream(spark, parts), ttl), "lives", tmp_path)}
    events = spark.read.parquet(parts)
    per = lives(events, ttl).groupBy("user_id", "began").agg(F.count("*").alias("n")).collect()
    now = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] - 3_600_000_000
    want = {(r.user_id, r.began // 1000, r.n) for r in per if r.began + ttl * 1_000_000 <= now}
    ends = {(u, b): n for u, b, n in got}
    assert want <= got and len(ends) == len(got)  # each life is purged once
    later = {(r.user_id, r.began // 1000, r.n) for r in per} - want
    assert got - want <= later


def test_wakes_equal_the_batch_twin(spark, parts, tmp_path):
    rules = (3, 7200, 1800, 2)
    got = {(r.model, r.event_id): r.state for r in run(spark, timers.wake_requests(stream(spark, parts), *rules), "wakes", tmp_path)}
    want = {(r.model, r.event_id): r.state for r in wake_states(spark.read.parquet(parts), *rules).collect()}
    assert got == want and set(want.values()) == {"woken", "waking", "awake", "limit"}


def test_wake_rules():
    w = Waker(240, 60, 2)
    s = 1_000_000
    assert w.take(0, "view") == "woken" and w.take(30 * s, "view") == "waking"
    assert w.take(70 * s, "view") == "awake"  # the wake-up was heard at 60
    assert w.take(301 * s, "view") == "woken" and w.take(900 * s, "view") == "limit"
    assert w.take(901 * s, "click") is None and w.take(1000 * s, "view") == "awake"
    assert w.take(86_400 * s, "view") == "woken"  # a new day


def test_fan_out_survives_a_replay(spark, parts, tmp_path):
    subscriptions = spark.createDataFrame([("a", u) for u in range(0, 40)] + [("b", u) for u in range(20, 60)], "subscriber string, user_id bigint")
    folder = str(tmp_path / "out")
    q = windows.fan_out(stream(spark, parts), subscriptions, folder, str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    events = spark.read.parquet(parts)
    want = sorted((r.subscriber, r.event_id) for r in events.join(subscriptions, "user_id").collect())
    assert sorted((r.subscriber, r.event_id) for r in windows.deliveries(spark, folder).collect()) == want
    first = sorted(r.batch for r in windows.deliveries(spark, folder).select("batch").distinct().collect())[0]
    again = windows.deliveries(spark, folder).where(F.col("batch") == first).select("event_id").distinct()
    replayed = events.join(again, "event_id", "left_semi")
    windows.write_batch(replayed.unionByName(replayed), subscriptions, folder, first)  # the batch comes again, and holds each event twice
    assert sorted((r.subscriber, r.event_id) for r in windows.deliveries(spark, folder).collect()) == want
