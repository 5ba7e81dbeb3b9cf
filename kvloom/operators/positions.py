"""Numbers of rows in the order of their key, whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which a key is numbered in parts, and how many parts.
MANY, PARTS = 1_000_000, 64


def prefix_number(text: Column) -> Column:
    """A long that orders texts as their first seven bytes do."""
    head = F.substring(text.cast("binary"), 1, 7)
    return F.conv(F.rpad(F.hex(head), 14, "0"), 16, 10).cast("long")


def numbered(rows: DataFrame, key: str, order: list[Column], rough: Column, name: str, many: int = MANY) -> DataFrame:
    """The rows with their place from 0 among the rows of their key, in that order.

    ``rough`` is a number that never falls along the order. Keys of more than ``many`` rows are cut at its quantiles; parts are
    numbered apart and begin after the rows of the parts before them. Rows of equal ``rough`` stay in one part.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).select(key)
    if hot.isEmpty():
        w = Window.partitionBy(key).orderBy(*order)
        return rows.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    cuts = [i / PARTS for i in range(1, PARTS)]
    bounds = rows.withColumn("__rough", rough).join(hot, key, "left_semi").groupBy(key).agg(F.percentile_approx("__rough", cuts, 100 * PARTS).alias("__cuts"))
    part = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__rough"))), F.lit(0))
    placed = rows.withColumn("__rough", rough).join(bounds, key, "left").withColumn("__part", F.when(F.col("__cuts").isNull(), 0).otherwise(part)).drop("__cuts", "__rough")
    sizes = placed.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("__start", F.coalesce(before, F.lit(0))).drop("n")  # at most PARTS rows a key
    w = Window.partitionBy(key, "__part").orderBy(*order)
    own = placed.withColumn("__own", F.row_number().over(w)).join(starts, [key, "__part"])
    return own.withColumn(name, (F.col("__start") + F.col("__own") - 1).cast("long")).select(*rows.columns, name)


def counted(rows: DataFrame, key: str = "key") -> DataFrame:
    """The rows with the number n of their key's; a count is summed in tasks first, so a hot key is none."""
    return rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)
