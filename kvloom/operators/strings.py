"""Strings and counters over a log of writes (key, value, us, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.sources.views import place


def last_write(writes: DataFrame, value: str = "value") -> DataFrame:
    """SET, MSET: the last value of each key. Tasks keep one row a key before anything is shuffled, so a hot key is none."""
    return writes.groupBy("key").agg(F.max_by(value, place()).alias(value))


def first_write(writes: DataFrame, value: str = "value") -> DataFrame:
    """SETNX over an empty keyspace: the first value of each key."""
    return writes.groupBy("key").agg(F.min_by(value, place()).alias(value))


def set_nx(keyspace: DataFrame, writes: DataFrame) -> DataFrame:
    """Keys that SETNX adds: those that are not there, with their first value."""
    return first_write(writes.join(keyspace.select("key"), "key", "left_anti"))


def set_xx(keyspace: DataFrame, writes: DataFrame) -> DataFrame:
    """Keys that SET XX changes: those that are there, with their last value."""
    return last_write(writes.join(keyspace.select("key"), "key", "left_semi"))


def set_ex(writes: DataFrame, ttl_us: int) -> DataFrame:
    """SETEX, PSETEX: the last value and when it expires."""
    return writes.groupBy("key").agg(F.max_by("value", place()).alias("value"), (F.max_by("us", place()) + ttl_us).alias("expire_at_us"))


def getset(writes: DataFrame) -> DataFrame:
    """The value that each write replaced; null if there was none or it was empty."""
    old = F.lag("value").over(Window.partitionBy("key").orderBy("us", "seq"))
    return writes.select("seq", "key", F.nullif(old, F.lit("")).alias("old"))


def mget(keyspace: DataFrame, request: DataFrame) -> DataFrame:
    """request: pos, key, with repeats. A missing key's value is null."""
    return request.join(keyspace.select("key", "value"), "key", "left").select("pos", "key", "value")


def get(keyspace: DataFrame, probes: DataFrame) -> DataFrame:
    """keyspace: key, type, value. The value of each probed key; null if it is not there, and with an error if it is no string."""
    found = probes.join(keyspace.select("key", "type", "value"), "key", "left")
    wrong = F.col("type") != "string"
    return found.select("key", F.when(~wrong, F.col("value")).alias("value"), F.when(wrong, "WRONGTYPE").alias("error"))


def get_as_of(writes: DataFrame, probes: DataFrame) -> DataFrame:
    """probes: request, key, us. The value of the key at that time: that of the last write until then."""
    w = writes.select("key", "value", F.col("us").alias("w_us"), F.col("seq").alias("w_seq"))
    # of a key's writes, a request keeps one in each task
    joined = probes.join(w, (probes["key"] == w["key"]) & (w["w_us"] <= probes["us"]), "left")
    return joined.groupBy("request").agg(F.max_by("value", F.struct("w_us", "w_seq")).alias("value"))


def append(writes: DataFrame) -> DataFrame:
    """The ordered concatenation of a key's values; this is the value of one key, so it is as large as that."""
    ordered = F.array_sort(F.collect_list(F.struct("us", "seq", "value")))
    return writes.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "").alias("value"))


def strlen(values: DataFrame) -> DataFrame:
    """Bytes, not characters."""
    return values.select("key", F.octet_length("value").cast("long").alias("bytes"))


def incr_total(deltas: DataFrame, sign: int = 1) -> DataFrame:
    """INCRBY, DECRBY: the counter after all. An overflow is an error."""
    return deltas.groupBy("key").agg(F.sum(F.col("delta") * sign).alias("total"))


def incr_trace(deltas: DataFrame) -> DataFrame:
    """What each INCRBY returned."""
    w = Window.partitionBy("key").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("seq", "key", F.sum("delta").over(w).alias("total"))
