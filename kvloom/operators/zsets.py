"""Sorted sets in long form: key, member, score. The order is by score, then by the member's bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.operators.positions import counted, numbered
from kvloom.sources.views import place


def zadd(writes: DataFrame) -> DataFrame:
    """The last score of each member; a score that is not a number is refused."""
    return writes.where(~F.isnan("score")).groupBy("key", "member").agg(F.max_by("score", place()).alias("score"))


def zincrby(writes: DataFrame) -> DataFrame:
    return writes.groupBy("key", "member").agg(F.sum("score").alias("score"))


def ranked(rows: DataFrame, descending: bool = False) -> DataFrame:
    """ZRANK: rows with their rank from 0."""
    by = [F.desc("score"), F.desc("member")] if descending else [F.asc("score"), F.asc("member")]
    rough = -F.col("score") if descending else F.col("score")
    return numbered(rows.select("key", "member", "score"), "key", by, rough, "rank")


def top(rows: DataFrame, n: int, descending: bool = False) -> DataFrame:
    """ZRANGE 0 n-1: each task keeps n rows a key before anything is shuffled."""
    by = [F.desc("score"), F.desc("member")] if descending else ["score", "member"]
    r = F.row_number().over(Window.partitionBy("key").orderBy(*by))
    return rows.withColumn("r", r).where(F.col("r") <= n).select("key", (F.col("r") - 1).cast("long").alias("rank"), "member", "score")


def zrange(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """Any range, with scores; ends may be negative."""
    from kvloom.operators.lists import bounds

    first, last = bounds(start, stop, F.col("n"))
    return counted(ranked(rows)).where(F.col("rank").between(first, last)).select("key", "rank", "member", "score")


def zcard(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"))


def zcount(rows: DataFrame, low: float, high: float) -> DataFrame:
    return rows.groupBy("key").agg(F.count_if(F.col("score").between(low, high)).alias("members"))


def zrem(rows: DataFrame, members: DataFrame) -> DataFrame:
    return rows.join(members, ["key", "member"], "left_anti").select("key", "member", "score")
