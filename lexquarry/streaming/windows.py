"""Structured Streaming twins of the batch plans: file source in, any sink out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators.stateful import SlidingWindow

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Events as a stream; event time becomes a zoned timestamp, as watermarks ask."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and type; rows later than the watermark are dropped."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("window.start").alias("hour"), "event_type", "n", "total")
    )


def once_per_identity(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first delivery of each event id within the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def admitted(stream: DataFrame, limit: int, width_seconds: int) -> DataFrame:
    """Sliding-window admission with state by user: accepted times in the window."""
    width = width_seconds * 1_000_000

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        window = SlidingWindow(limit, width)
        if state.exists:
            window.accepted.extend(state.get[0])
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        verdicts = [window.take(int(at)) for at in rows["at"]]
        state.update((list(window.accepted),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "accepted": [a for a, _ in verdicts], "wait_seconds": [-(-w // 1_000_000) for _, w in verdicts]})

    rows = stream.select("user_id", "event_id", F.unix_micros("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, accepted boolean, wait_seconds long", "accepted array<long>", "append", "NoTimeout")


def fan_out(stream: DataFrame, subscriptions: DataFrame, folder: str, checkpoint: str):
    """Deliver each event to every subscriber of its key, once however often a batch is replayed.

    subscriptions: subscriber, user_id. A batch is written to a folder of its own id, which a replay writes anew, so a
    batch that failed half-way or whose commit was lost leaves no second copy. The query, for the caller to start.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, subscriptions, folder, batch_id)

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)


def write_batch(batch: DataFrame, subscriptions: DataFrame, folder: str, batch_id: int) -> None:
    """One batch's deliveries; an event delivered twice to a subscriber within it counts once."""
    rows = batch.join(subscriptions, "user_id").select("subscriber", "user_id", "event_id", "ts", "event_type").dropDuplicates(["subscriber", "event_id"])
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
