"""Expiry. Rows have expire_at_us, null for never; ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(now: int) -> Column:
    """A key can be seen up to and at the time at which it expires."""
    return F.col("expire_at_us").isNull() | (F.lit(now) <= F.col("expire_at_us"))


def visible(keyspace: DataFrame, now: int) -> DataFrame:
    return keyspace.where(live(now))


def ttl(keyspace: DataFrame, probes: DataFrame, now: int, unit_us: int = 1_000_000, compat: bool = False) -> DataFrame:
    """TTL (PTTL with unit_us = 1000): what is left; -1 without an expiry and -2 without a key.

    With compat, as the reference has it: 0 without an expiry, and -2 seconds in the unit without a key.
    """
    never, missing = (0, -2 * 1_000_000 // unit_us) if compat else (-1, -2)
    there = visible(keyspace, now).select("key", "expire_at_us", F.lit(True).alias("there"))
    left = F.when(F.col("there").isNull(), F.lit(missing)).when(F.col("expire_at_us").isNull(), F.lit(never)).otherwise(F.floor((F.col("expire_at_us") - now) / unit_us))
    return probes.join(there, "key", "left").select("key", left.cast("long").alias("ttl"))


def expire(keyspace: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """EXPIRE, PEXPIRE; requests: key, ttl_us. A time to live of 0 or less clears the expiry."""
    joined = visible(keyspace, now).join(requests, "key", "left")
    at = F.when(F.col("ttl_us").isNull(), F.col("expire_at_us")).when(F.col("ttl_us") > 0, F.col("ttl_us") + now)
    return joined.withColumn("expire_at_us", at).drop("ttl_us")


def expire_at(keyspace: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """EXPIREAT; requests: key, at_us. A time that has passed deletes the key."""
    joined = visible(keyspace, now).join(requests, "key", "left").where(F.col("at_us").isNull() | (F.col("at_us") > now))
    return joined.withColumn("expire_at_us", F.coalesce("at_us", "expire_at_us")).drop("at_us")


def persist(keyspace: DataFrame, keys: DataFrame) -> DataFrame:
    joined = keyspace.join(keys.withColumn("p", F.lit(True)), "key", "left")
    return joined.withColumn("expire_at_us", F.when(F.col("p").isNull(), F.col("expire_at_us"))).drop("p")


def evict_lfu(stats: DataFrame, n: int, volatile: bool = False) -> DataFrame:
    """The n keys that are used the least; of equal ones, the first. LRU does the same in the reference."""
    rows = stats.where(F.col("expire_at_us").isNotNull()) if volatile else stats
    return rows.orderBy("uses", "key").limit(n).select("key", "uses")


def evict_ttl(keyspace: DataFrame, n: int) -> DataFrame:
    """The n keys that expire the soonest."""
    return keyspace.where(F.col("expire_at_us").isNotNull()).orderBy("expire_at_us", "key").limit(n).select("key", "expire_at_us")


def evict_random(keyspace: DataFrame, n: int) -> DataFrame:
    return keyspace.orderBy(F.md5(F.col("key").cast("binary")), "key").limit(n).select("key")
