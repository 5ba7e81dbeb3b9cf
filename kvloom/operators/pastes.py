"""The paste application: validation, reading with limits, listing, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The presets of a paste's time to live, in seconds, and the largest content in bytes.
PRESETS = {"5m": 300, "30m": 1800, "1h": 3600, "6h": 21600, "1d": 86400, "7d": 604800}
MOST_BYTES = 65_536


def preset_seconds(ttl: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, seconds in PRESETS.items():
        out = F.when(ttl == name, F.lit(seconds).cast("long")).otherwise(out)
    return out


def validate(pastes: DataFrame) -> DataFrame:
    """pastes: code, content, ttl, max_views, burn. What is wrong with each, first of all; "ok" if nothing."""
    error = (
        F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty")
        .when(F.octet_length("content") > MOST_BYTES, "too large")
        .when(preset_seconds(F.col("ttl")).isNull(), "bad ttl")
        .when(F.col("max_views") < 0, "bad views")
        .when(F.col("burn") & (F.col("max_views") > 0), "exclusive")
        .otherwise("ok")
    )
    return pastes.select("code", error.alias("result"))


def read(pastes: DataFrame, reads: DataFrame) -> DataFrame:
    """reads: code, us, seq. Which reads get the content: the first alone of one that burns, ``max_views`` of one with a limit."""
    n = F.row_number().over(Window.partitionBy("code").orderBy("us", "seq"))
    joined = reads.withColumn("n", n).join(pastes.select("code", "max_views", "burn", "created_us", "ttl_s"), "code", "left")
    alive = F.col("created_us").isNotNull() & (F.col("us") <= F.col("created_us") + F.col("ttl_s") * 1_000_000) & (F.col("us") >= F.col("created_us"))
    limit = F.when(F.col("burn"), 1).when(F.col("max_views") > 0, F.col("max_views"))
    return joined.select("seq", "code", (F.coalesce(alive, F.lit(False)) & (limit.isNull() | (F.col("n") <= limit))).alias("served"))


def admin_list(pastes: DataFrame, views: DataFrame, page: int | None = None) -> DataFrame:
    """All pastes that still have views left; with ``page``, the newest so many in order."""
    seen = views.groupBy("code").agg(F.count(F.lit(1)).alias("views"))
    left = pastes.join(seen, "code", "left").withColumn("views", F.coalesce("views", F.lit(0)))
    open_ones = left.where((F.col("max_views") == 0) | (F.col("views") < F.col("max_views")))
    if page is not None:
        open_ones = open_ones.orderBy(F.desc("created_us"), "code").limit(page)
    return open_ones.select("code", "created_us", "views")


def usage(pastes: DataFrame, served: DataFrame, now: int) -> DataFrame:
    made = pastes.agg(F.count(F.lit(1)).alias("created"), F.count_if(F.col("created_us") + F.col("ttl_s") * 1_000_000 < now).alias("expired"))
    reads = served.join(pastes.select("code", "burn"), "code").agg(F.count_if("served").alias("read"), F.count_if(F.col("served") & F.col("burn")).alias("burned"), F.count_if(~F.col("served")).alias("refused"))
    return made.crossJoin(reads)  # one row each


def rate_limit(requests: DataFrame, most: int, width_us: int) -> DataFrame:
    """requests: client, us, seq. Which are let through: ``most`` in a window that begins with the first request after the last window.

    Where a window begins depends on the one before, so a client's requests are folded in order, as a stream.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, begin, n = None, 0, 0
        for frame in frames:
            passed = []
            for c, us in zip(frame["client"], frame["us"]):
                if c != client or us >= begin + width_us:
                    client, begin, n = c, us, 0
                n += 1
                passed.append(n <= most)
            yield frame[["client", "seq"]].assign(passed=passed)

    dealt = requests.select("client", "us", "seq").repartition("client").sortWithinPartitions("client", "us", "seq")
    kind = requests.schema["client"].dataType.simpleString()
    return dealt.mapInPandas(fold, f"client {kind}, seq long, passed boolean")
