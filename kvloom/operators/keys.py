"""Keys of any type: keyspace rows are (key, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.functions.globs import matches


def exists(keyspace: DataFrame, request: DataFrame) -> DataFrame:
    """How many of a request's keys are there; repeats count each time. One row a request."""
    found = request.join(keyspace.select("key"), "key", "left_semi").groupBy("request").agg(F.count(F.lit(1)).alias("found"))
    return request.select("request").distinct().join(found, "request", "left").select("request", F.coalesce("found", F.lit(0)).alias("found"))


def delete(keyspace: DataFrame, keys: DataFrame) -> DataFrame:
    return keyspace.join(keys, "key", "left_anti")


def delete_count(keyspace: DataFrame, keys: DataFrame) -> DataFrame:
    return keyspace.join(keys, "key", "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("deleted"))


def type_of(keyspace: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(keyspace, "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def match(keyspace: DataFrame, glob: str) -> DataFrame:
    return keyspace.where(matches(F.col("key"), glob)).select("key", "type")


def rename(keyspace: DataFrame, renames: DataFrame) -> DataFrame:
    """renames: key, newkey (each once). A key that is there takes its new name, and what had that name goes."""
    there = keyspace.join(renames, "key").select(F.col("newkey").alias("key"), *[c for c in keyspace.columns if c != "key"])
    stays = keyspace.join(renames.select("key"), "key", "left_anti").join(there.select("key"), "key", "left_anti")
    return stays.unionByName(there)


def scan_page(keyspace: DataFrame, after: str, count: int) -> DataFrame:
    """A page of keys in order, after the last key of the page before: tasks keep ``count`` rows each."""
    return keyspace.where(F.col("key") > after).orderBy("key").limit(count).select("key", "type")


def dbsize(keyspace: DataFrame) -> DataFrame:
    return keyspace.groupBy("type").agg(F.count(F.lit(1)).alias("keys"))


def random_keys(keyspace: DataFrame, n: int) -> DataFrame:
    """n keys, the same for the same keyspace: those whose digests are the smallest."""
    return keyspace.orderBy(F.md5(F.col("key").cast("binary")), "key").limit(n).select("key")


def flush(keyspace: DataFrame) -> DataFrame:
    return keyspace.where(F.lit(False))
