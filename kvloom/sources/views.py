"""The command log and the typed long-form views, as shaped from the fixture tables.

A log row has a key, its operation's arguments and a place in order: ``us`` (microseconds) and
``seq``, which breaks ties. No view numbers the whole log, so none needs a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time at which fixture queries look at the keyspace: 2024-01-31 00:00:00 UTC.
NOW_US = 1_706_659_200_000_000
#: Time to live of fixture rows.
TTL_US = 5 * 86_400 * 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def place() -> Column:
    """What orders a log."""
    return F.struct("us", "seq")


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as commands: key, op, value (text), delta (integer), score, us, seq."""
    e = table(spark, folder, "events")
    return e.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.col("event_type").alias("op"),
        F.floor("value").cast("long").alias("delta"),
        F.floor("value").cast("long").cast("string").alias("text"),
        F.col("value").alias("score"),
        micros(F.col("ts")).alias("us"),
        F.col("event_id").alias("seq"),
        "user_id",
        "props",
    )


def str_rows(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).select("key", F.col("op").alias("value"), "us", "seq")


def hash_rows(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).select("key", F.col("op").alias("field"), F.col("text").alias("value"), "us", "seq")


def list_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Pushes: at the left if seq is odd."""
    return log(spark, folder).select("key", F.col("op").alias("value"), (F.col("seq") % 2 == 1).alias("left"), "us", "seq")


def set_rows(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).select(F.concat(F.lit("type:"), "op").alias("key"), F.col("user_id").cast("string").alias("member"))


def zset_rows(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).select(F.concat(F.lit("type:"), "op").alias("key"), F.col("key").alias("member"), "score", "us", "seq")


def register(spark: SparkSession, folder: str) -> SparkSession:
    """A session in which SQL finds the log and the typed views: kv_log, kv_strings, kv_hashes, kv_sets, kv_zsets and kv_keys."""
    session = spark.newSession()
    views = {"kv_log": log, "kv_strings": str_rows, "kv_hashes": hash_rows, "kv_sets": set_rows, "kv_zsets": zset_rows, "kv_keys": typed_keys}
    for name, view in views.items():
        view(session, folder).createOrReplaceTempView(name)
    return session


def customer_keys(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), "c_custkey", "c_mktsegment", "c_nationkey")


def typed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Every key once, with its type: users are strings, customers hashes, event types sets and ranks sorted sets."""
    e = log(spark, folder)
    kinds = [
        (e.select("key"), "string"),
        (customer_keys(spark, folder).select("key"), "hash"),
        (e.select(F.concat(F.lit("list:"), F.col("user_id").cast("string")).alias("key")), "list"),
        (e.select(F.concat(F.lit("type:"), "op").alias("key")), "set"),
        (e.select(F.concat(F.lit("rank:"), "op").alias("key")), "zset"),
    ]
    parts = [df.distinct().withColumn("type", F.lit(kind)) for df, kind in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
