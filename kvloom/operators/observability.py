"""Service metrics from a command log: counters, histograms and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the latency histogram, in seconds.
BUCKETS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0)


def command_counts(log: DataFrame, known: list[str]) -> DataFrame:
    """Commands by name and status; names that are not known are one."""
    name = F.when(F.col("cmd").isin(known), F.col("cmd")).otherwise("other")
    return log.groupBy(name.alias("cmd"), "status").agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(log: DataFrame, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Commands at or under each bound, by name; the last row has all."""
    counts = log.groupBy("cmd").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return counts.select("cmd", F.explode(F.array(*rows)).alias("r")).select("cmd", "r.le", "r.n")


def error_rate(log: DataFrame, width_us: int, limit: float = 0.05) -> DataFrame:
    """Errors a command in each window, and whether that is over the limit; a rate under one command a second counts as one."""
    window = F.floor(F.col("us") / width_us)
    counts = log.groupBy(window.alias("win")).agg(F.count_if(F.col("status") == "error").alias("errors"), F.count(F.lit(1)).alias("total"))
    seconds = F.lit(width_us / 1_000_000)
    ratio = (F.col("errors") / seconds) / F.greatest(F.col("total") / seconds, F.lit(1.0))
    return counts.select("win", "errors", "total", ratio.alias("ratio"), (ratio > limit).alias("alert"))


def error_rate_sliding(log: DataFrame, width_us: int, step_us: int, limit: float = 0.05) -> DataFrame:
    """``error_rate`` of windows that begin every ``step_us``, of which each command is in several; start: where one begins."""
    before = F.explode(F.sequence(F.lit(0), F.lit(width_us // step_us - 1)))
    spread = log.select("us", "status", before.alias("k")).withColumn("start", (F.floor(F.col("us") / step_us) - F.col("k")) * step_us)
    # a command goes to all its windows, and each task sums them before it sends anything
    counts = spread.groupBy("start").agg(F.count_if(F.col("status") == "error").alias("errors"), F.count(F.lit(1)).alias("total"))
    seconds = F.lit(width_us / 1_000_000)
    ratio = (F.col("errors") / seconds) / F.greatest(F.col("total") / seconds, F.lit(1.0))
    return counts.select("start", "errors", "total", ratio.alias("ratio"), (ratio > limit).alias("alert"))


def quantile(log: DataFrame, q: float = 0.99, limit: float = 0.1, many: int = 100_000) -> DataFrame:
    """The exact quantile of each command's seconds, between its two neighbours in proportion.

    Equal times are counted first. The times of a command of more than ``many`` rows are cut at its rough quantiles, so that
    no task holds more than a part of them; only the part that has the wanted rank is ordered.
    """
    times = log.groupBy("cmd", "seconds").agg(F.count(F.lit(1)).alias("n"))
    total = log.groupBy("cmd").agg(F.count(F.lit(1)).alias("m"), F.percentile_approx("seconds", [max(q - 0.005, 0.0), min(q + 0.005, 1.0)], 2000).alias("near"))
    low, high = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    joined = times.join(total, "cmd")
    side = joined.select("cmd", "seconds", "n", "m", F.when(F.col("m") <= many, 0).when(F.col("seconds") < low, -1).when(F.col("seconds") > high, 1).otherwise(0).alias("side"))
    below = side.groupBy("cmd", "m").agg(F.sum(F.when(F.col("side") < 0, F.col("n")).otherwise(0)).alias("below"), F.min(F.when(F.col("side") > 0, F.col("seconds"))).alias("next"))
    own = side.where("side = 0").select("cmd", "seconds", "n")
    upto = F.sum("n").over(Window.partitionBy("cmd").orderBy("seconds")).alias("upto")
    ranked = own.select("cmd", "seconds", "n", upto).join(below, "cmd")
    place = F.lit(q) * (F.col("m") - 1)
    # ranks from 0 that a time has, those before it left out
    end = F.col("below") + F.col("upto") - 1
    at = lambda rank: F.min(F.when(end >= rank, F.col("seconds")))
    found = ranked.groupBy("cmd").agg(at(F.floor(place)).alias("a"), F.coalesce(at(F.ceil(place)), F.first("next")).alias("b"), F.first("m").alias("m"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))
    return found.select("cmd", value.alias("value"), (value > limit).alias("alert"))


def idle_counter(samples: DataFrame) -> DataFrame:
    """samples: name, win, total. Windows in which a counter did not grow."""
    before = F.lag("total").over(Window.partitionBy("name").orderBy("win"))
    return samples.withColumn("grown", F.col("total") - before).where("grown = 0").select("name", "win", "total")


def overview(log: DataFrame, width_us: int) -> DataFrame:
    """Operations, hits, misses and keys of each window."""
    return log.groupBy(F.floor(F.col("us") / width_us).alias("win")).agg(
        F.count(F.lit(1)).alias("ops"),
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.count_distinct("key").alias("keys"),
    )


def key_detail(keyspace: DataFrame, shown: int = 1 << 20, most: int = 50 << 20) -> DataFrame:
    """Strings with their size; a large one is shown in part, a very large one not at all."""
    size = F.octet_length("value").cast("long")
    value = F.when(size > most, F.lit(None).cast("string")).otherwise(F.substring("value", 1, shown))
    return keyspace.select("key", size.alias("size"), value.alias("value"), (size > shown).alias("truncated"))


def audit(log: DataFrame, n: int = 1024) -> DataFrame:
    """The last n entries."""
    return log.orderBy(F.desc("us"), F.desc("seq")).limit(n).select("us", "seq", "key", "op")
