"""Sets in long form: key, member."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.operators.positions import numbered, prefix_number


def sadd(rows: DataFrame) -> DataFrame:
    return rows.select("key", "member").distinct()


def sadd_added(rows: DataFrame, new: DataFrame) -> DataFrame:
    """How many members SADD adds to each key."""
    fresh = new.select("key", "member").distinct().join(rows, ["key", "member"], "left_anti")
    return fresh.groupBy("key").agg(F.count(F.lit(1)).alias("added"))


def scard(rows: DataFrame) -> DataFrame:
    """Members of each key; rows may repeat."""
    return sadd(rows).groupBy("key").agg(F.count(F.lit(1)).alias("members"))


def smembers(rows: DataFrame) -> DataFrame:
    """Members in order of their bytes, a row each."""
    return numbered(sadd(rows), "key", [F.asc("member")], prefix_number(F.col("member")), "i")


def sismember(rows: DataFrame, probes: DataFrame) -> DataFrame:
    there = sadd(rows).withColumn("there", F.lit(1))
    return probes.join(there, ["key", "member"], "left").select("key", "member", F.coalesce("there", F.lit(0)).cast("long").alias("found"))


def srem(rows: DataFrame, members: DataFrame) -> DataFrame:
    return sadd(rows).join(members, ["key", "member"], "left_anti").select("key", "member")


def union(rows: DataFrame, a: str, b: str) -> DataFrame:
    """An extension: the reference declares the set operations without implementing them."""
    return rows.where(F.col("key").isin(a, b)).select("member").distinct()


def inter(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col("key") == a).select("member").intersect(rows.where(F.col("key") == b).select("member"))


def diff(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col("key") == a).select("member").subtract(rows.where(F.col("key") == b).select("member"))


def sample(rows: DataFrame, n: int) -> DataFrame:
    """SRANDMEMBER, SPOP (an extension): n members of each key, the same for the same set: those whose digests are the smallest."""
    w = Window.partitionBy("key").orderBy(F.md5(F.col("member").cast("binary")), "member")
    return sadd(rows).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("key", "member")


def pop(rows: DataFrame, n: int) -> DataFrame:
    """SPOP (an extension): the members that stay once ``sample`` has gone."""
    return srem(rows, sample(rows, n))
