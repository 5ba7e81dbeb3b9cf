"""Hashes in long form: key, field, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.sources.views import place


def hset(writes: DataFrame) -> DataFrame:
    """The last value of each field."""
    return writes.groupBy("key", "field").agg(F.max_by("value", place()).alias("value"))


def hset_added(rows: DataFrame, writes: DataFrame) -> DataFrame:
    """How many fields HSET adds to each key."""
    new = writes.select("key", "field").distinct().join(rows.select("key", "field"), ["key", "field"], "left_anti")
    return new.groupBy("key").agg(F.count(F.lit(1)).alias("added"))


def hget(rows: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(rows, ["key", "field"], "left").select("key", "field", "value")


def hexists(rows: DataFrame, probes: DataFrame) -> DataFrame:
    there = rows.select("key", "field").withColumn("there", F.lit(1))
    return probes.join(there, ["key", "field"], "left").select("key", "field", F.coalesce("there", F.lit(0)).cast("long").alias("found"))


def hdel(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """What is left; a key without fields is no more."""
    return rows.join(fields, ["key", "field"], "left_anti").select("key", "field", "value")


def hdel_count(rows: DataFrame, fields: DataFrame) -> DataFrame:
    return rows.join(fields.distinct(), ["key", "field"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("deleted"))


def nested(rows: DataFrame) -> DataFrame:
    """HGETALL, HKEYS, HVALS: a key's pairs of field and value in order of the fields' bytes, with fields and values apart as well, as arrays."""
    own = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("pairs"))
    return own.select("key", "pairs", F.col("pairs.field").alias("fields"), F.col("pairs.value").alias("vals"))


def hgetall(rows: DataFrame) -> DataFrame:
    """``nested`` as text to look at: pairs, fields and values joined by commas, a null value as nothing."""
    pairs = F.transform("pairs", lambda p: F.concat(p["field"], F.lit("="), F.coalesce(p["value"], F.lit(""))))
    return nested(rows).select("key", F.array_join(pairs, ",").alias("pairs"), F.array_join("fields", ",").alias("fields"), F.array_join("vals", ",", "").alias("vals"))


def hlen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("fields"))
