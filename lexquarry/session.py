"""Session settings every program here relies on, and the shared work folder."""

from __future__ import annotations

import gc
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", partitions: int = 8, app: str = "lexquarry", memory: str = "12g") -> SparkSession:
    """A local session with the settings used in tests and the benchmark."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of one task: bytes of a text column, rows of a narrow table.
TEXT_BYTES, TASK_ROWS = 4_000_000, 500_000


def dealt(df: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """The rows dealt by key over as many tasks as their text or their number asks for.

    A file's row group is read by one task whatever it holds, and what follows in that task grows with it; dealt rows have a
    bound that neither the file nor the session's number of partitions moves. One aggregate reads the size first.
    """
    size, each = (F.sum(F.octet_length(text)), TEXT_BYTES) if text else (F.count("*"), TASK_ROWS)
    total = df.agg(size.alias("n")).first().n or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // each)), key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (local mode only)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor share")
    local = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"lexquarry-checkpoints-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(local)
    return local


#: Bits of among(): four megabytes.
SLOTS = 1 << 25


def among(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose keys stand in a row of wanted (the same columns), and few others: a bitmap of fixed size is sent, the rows stay where they are."""
    ensure_checkpoint_dir(rows.sparkSession)
    slot = lambda: F.pmod(F.xxhash64(*keys), F.lit(SLOTS)) + 1
    bits = wanted.select(slot().alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).checkpoint()
    met = rows.withColumn("slot", slot()).withColumn("bucket", F.bitmap_bucket_number("slot")).join(F.broadcast(bits), "bucket")
    place = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files and checkpoints that nothing refers to any more: it follows the JVM's collector."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
