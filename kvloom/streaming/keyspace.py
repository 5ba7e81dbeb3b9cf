"""Streams of the command log.

The same operators as in batch, fed by a file stream. Sinks get the rows of each micro-batch by
foreachBatch, and what is read back is the last version of each key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.sources import views as V

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def source(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table's file or folder as a stream."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if place.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # streams read folders: of this one, the file of that name
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def commands(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.col("event_type").alias("op"),
        V.micros(F.col("ts")).alias("us"),
        F.col("event_id").alias("seq"),
    )


def drain(spark: SparkSession, df: DataFrame, mode: str = "append", no_data: bool = False) -> DataFrame:
    """Runs a query over what there is, and reads back what its sink got, with the batch it came in.

    The stream takes its options from the session of its rows, which for queries is one of their own.
    """
    spark = df.sparkSession
    base = shared_folder(spark)
    parts = f"{base}/rows"
    before = spark.conf.get(NO_DATA)
    # with state that ages by the clock, batches without data would never end
    spark.conf.set(NO_DATA, str(no_data).lower())
    try:
        write: Callable[[DataFrame, int], None] = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{parts}/n={n}")
        stream = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(NO_DATA, before)
    stream.awaitTermination()
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{parts}/n=*")


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: beside the checkpoints; in a local session without them, in the warehouse."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/.streams"
    path = f"{root}/{uuid.uuid4().hex}"
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def last_versions(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the last batch, which replaces those before it."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*").drop("batch")


def keep_last(rows: DataFrame) -> DataFrame:
    """The keyspace of strings as state: each key's last value and how many writes it had."""
    return rows.groupBy("key").agg(F.max_by("op", F.struct("us", "seq")).alias("value"), F.count(F.lit(1)).alias("writes"))


def drain_keyspace(spark: SparkSession, folder: str) -> DataFrame:
    return last_versions(drain(spark, keep_last(commands(source(spark.newSession(), folder))), "update"), "key")


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Commands by window and name, with a bound on how late they may come."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), F.col("event_type").alias("op")).agg(F.count(F.lit(1)).alias("n"))


def _utc(spark: SparkSession) -> SparkSession:
    """A session of its own whose times without zone are UTC."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def drain_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all days, those included that the watermark has not closed."""
    counts = windowed(source(_utc(spark), folder)).select(F.floor(F.unix_micros("w.start") / 86_400_000_000).alias("win"), "op", "n")
    return last_versions(drain(spark, counts, "update", no_data=True), "win", "op")


def deduped(rows: DataFrame, key: str, at: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each key's first row. With a time column, state is kept no longer than repeats may be late; without, for good."""
    if at is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def drain_deduped(spark: SparkSession, folder: str, late: str = "31 days") -> DataFrame:
    """Every command comes twice and is told once; a repeat may be ``late``, after which nothing is kept of it."""
    events = source(_utc(spark), folder)
    rows = commands(events).withColumn("at", F.timestamp_micros("us"))
    twice = rows.select("key", "op", "seq", "at", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).drop("n")
    return drain(spark, deduped(twice, "seq", "at", late).select("key", "op", "seq")).select("key", "op", "seq")


def expired(rows: DataFrame, ttl: str, late: str = "1 hour") -> DataFrame:
    """Keys whose time to live, counted from their last write, has ended: when, the last value and the writes of that life.

    A key's life is a session of writes, whose state goes as the watermark passes its end.
    """
    timed = rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    lives = timed.groupBy(F.session_window("at", ttl).alias("life"), "key").agg(F.max_by("op", F.struct("us", "seq")).alias("value"), F.count(F.lit(1)).alias("writes"))
    return lives.select("key", F.unix_micros("life.end").alias("expire_us"), "value", "writes")


def drain_expired(spark: SparkSession, folder: str, ttl: str = "2 days") -> DataFrame:
    return drain(spark, expired(commands(source(_utc(spark), folder)), ttl), no_data=True).drop("batch")
