"""Lists in long form: key, i (from 0), value.

A key's list is one ordered thing, so positions are numbered within a key, in parts if it is long. Replays of
pushes and pops in turn keep no more than the list itself while they read a key's rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.operators.positions import counted, numbered


def pushed(pushes: DataFrame) -> DataFrame:
    """LPUSH and RPUSH: rows (key, value, left, us, seq) as lists. A later push at the left stands further left."""
    sign = F.when(F.col("left"), -1).otherwise(1)
    rows = pushes.select("key", "value", (sign * F.col("us")).alias("__us"), (sign * F.col("seq")).alias("__seq"), sign.alias("__side"))
    # places in time are positive, so the left ones come first
    return numbered(rows, "key", [F.asc("__side"), F.asc("__us"), F.asc("__seq")], F.col("__us"), "i").select("key", "i", "value")


def llen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def bounds(start: int, stop: int, n: Column) -> tuple[Column, Column]:
    """The first and last index of an inclusive range whose ends may be negative; the last is before the first if it is empty."""
    first = F.greatest(F.lit(start) + (n if start < 0 else 0), F.lit(0))
    last = F.least(F.lit(stop) + (n if stop < 0 else 0), n - 1)
    return first, last


def lrange(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE and LTRIM: the rows within the range, numbered anew."""
    first, last = bounds(start, stop, F.col("n"))
    return counted(rows).where(F.col("i").between(first, last)).select("key", (F.col("i") - first).alias("i"), "value")


def lindex(rows: DataFrame, index: int) -> DataFrame:
    if index >= 0:
        return rows.where(F.col("i") == index).select("key", "value")
    return counted(rows).where(F.col("i") == F.col("n") + index).select("key", "value")


def lset(rows: DataFrame, index: int, value: str) -> DataFrame:
    """Keys whose list is too short stay as they are."""
    at = F.lit(index) + (F.col("n") if index < 0 else 0)
    return (counted(rows) if index < 0 else rows).select("key", "i", F.when(F.col("i") == at, F.lit(value)).otherwise(F.col("value")).alias("value"))


def popped(rows: DataFrame) -> DataFrame:
    """LPOP and then RPOP of each key, and how many elements are left."""
    n = F.count(F.lit(1))
    last = F.max_by("value", "i")
    return rows.groupBy("key").agg(F.min_by("value", "i").alias("lpop"), F.when(n > 1, last).alias("rpop"), F.greatest(n - 2, F.lit(0)).alias("rest"))


def replay(commands: DataFrame) -> DataFrame:
    """Lists after LPUSH, RPUSH, LPOP and RPOP in turn. commands: key, op, value, us, seq.

    The fold is sequential in a key. Rows are dealt and sorted by key, and each task folds its
    keys as a stream, so what it holds is the list of one key.
    """
    ops = {"LPUSH": deque.appendleft, "RPUSH": deque.append}

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, deque()

        def done() -> pd.DataFrame:
            return pd.DataFrame({"key": [key] * len(now), "i": range(len(now)), "value": list(now)})

        for frame in frames:
            for k, op, value in zip(frame["key"], frame["op"], frame["value"]):
                if k != key:
                    if now:
                        yield done()
                    key, now = k, deque()
                if op in ops:
                    ops[op](now, value)
                elif now:
                    now.popleft() if op == "LPOP" else now.pop()
        if now:
            yield done()

    dealt = commands.select("key", "op", "value", "us", "seq").repartition("key").sortWithinPartitions("key", "us", "seq")
    return dealt.mapInPandas(fold, "key string, i long, value string")
