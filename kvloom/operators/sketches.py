"""Frequencies: exact with the sketches' caps, and the sketches themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def capped_frequency(accesses: DataFrame, cap: int = 15) -> DataFrame:
    """Uses of each key up to the cap of a counter of four bits (15) or eight (255)."""
    return accesses.groupBy("key").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("frequency"))


def doorkeeper(accesses: DataFrame) -> DataFrame:
    """Keys that were seen twice or more, with the uses that a counter behind a doorkeeper has."""
    return accesses.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("counted")).where("counted > 0")


def admit(frequencies: DataFrame, pairs: DataFrame, strict: bool = False) -> DataFrame:
    """pairs: candidate, victim. A candidate comes in if it is used as much as the victim; if strict, more."""
    f = frequencies.select("key", "frequency")
    c = f.select(F.col("key").alias("candidate"), F.col("frequency").alias("cf"))
    v = f.select(F.col("key").alias("victim"), F.col("frequency").alias("vf"))
    joined = pairs.join(c, "candidate", "left").join(v, "victim", "left")
    cf, vf = F.coalesce("cf", F.lit(0)), F.coalesce("vf", F.lit(0))
    return joined.select("candidate", "victim", ((cf > vf) if strict else (cf >= vf)).alias("admitted"))


def decayed(accesses: DataFrame, bucket_us: int, buckets: int, now: int, older: bool = False) -> DataFrame:
    """A count that is halved, rounded down, after each interval, folded in order as rounding does not commute.

    What is older than all intervals doesn't count, as if counting began with the first of them; with ``older`` it counts in
    that one. Accesses after ``now`` don't count yet.
    """
    age = F.floor((F.lit(now) - F.col("us")) / bucket_us)
    age = (F.least(age, F.lit(buckets - 1)) if older else age).cast("int")
    counts = accesses.where((age >= 0) & (age < buckets)).groupBy("key", (F.lit(buckets - 1) - age).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    nested = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("by"))  # at most ``buckets`` entries
    steps = F.sequence(F.lit(0), F.lit(buckets - 1))
    fold = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, b: F.floor((acc + F.coalesce(F.try_element_at("by", b), F.lit(0).cast("long"))) / 2).cast("long"))
    return nested.select("key", fold.alias("uses"))


def count_min(accesses: DataFrame, error: float = 0.001, confidence: float = 0.99, seed: int = 7) -> DataFrame:
    """A count-min sketch of the keys, as bytes of a fixed size."""
    return accesses.agg(F.count_min_sketch("key", F.lit(error), F.lit(confidence), F.lit(seed)).alias("sketch"))


def distinct_keys(accesses: DataFrame, error: float = 0.02) -> DataFrame:
    return accesses.agg(F.approx_count_distinct("key", error).alias("approx"), F.countDistinct("key").alias("exact"))


def _cells(rows: DataFrame, width: int, depth: int) -> DataFrame:
    """rows (key, ...) once for each row of the sketch, with the cell of the key there."""
    return rows.withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(depth)))).withColumn("cell", F.pmod(F.xxhash64("line", "key"), F.lit(width)))


def count_min_table(accesses: DataFrame, width: int = 65_536, depth: int = 4, cap: int | None = None) -> DataFrame:
    """A count-min sketch as a table (line, cell, n) of at most depth x width rows; counters stop at the cap."""
    n = F.count(F.lit(1))
    return _cells(accesses.select("key"), width, depth).groupBy("line", "cell").agg((F.least(n, F.lit(cap)) if cap else n).alias("n"))


def estimated(table: DataFrame, keys: DataFrame, width: int = 65_536, depth: int = 4) -> DataFrame:
    """The sketch's estimate for each key (once): the least of its cells."""
    cells = _cells(keys.select("key"), width, depth).join(table, ["line", "cell"], "left")
    return cells.groupBy("key").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
