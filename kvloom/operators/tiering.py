"""Tiers: access statistics, placement policies and migrations.

Statistics are a row a key: key, uses, last_us, write_us, size, tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the default policy, and windows and weights of the cost-aware one.
HOT_USES, HOT_IDLE_S = 100, 300
WARM_USES, WARM_IDLE_S, COLD_IDLE_S = 10, 1800, 7200
WEIGHTS = {"uses": 1.0, "idle": 0.4, "size": 0.2, "write": 0.2}
DEMOTE_AT = -0.5


def access_stats(log: DataFrame) -> DataFrame:
    """log: key, us, bytes, is_write. The size is that of the latest access."""
    return log.groupBy("key").agg(
        F.count(F.lit(1)).alias("uses"),
        F.max("us").alias("last_us"),
        F.max(F.when(F.col("is_write"), F.col("us"))).alias("write_us"),
        F.max_by("bytes", F.struct("us", "seq")).alias("size"),
    )


def by_tier(stats: DataFrame) -> DataFrame:
    return stats.groupBy("tier").agg(F.count(F.lit(1)).alias("keys"), F.sum("size").alias("bytes"))


def idle_s(now: int) -> Column:
    return F.floor((F.lit(now) - F.col("last_us")) / 1_000_000)


def cold_keys(stats: DataFrame, now: int, idle: int, uses: int) -> DataFrame:
    """Hot keys that nobody needs."""
    return stats.where((F.col("tier") == "hot") & (idle_s(now) > idle) & (F.col("uses") < uses)).select("key")


def hot_keys(stats: DataFrame, uses: int) -> DataFrame:
    return stats.where((F.col("tier") != "hot") & (F.col("uses") > uses)).select("key")


def default_policy(stats: DataFrame, now: int) -> DataFrame:
    """Which way each key goes: demote, promote or stay."""
    idle = idle_s(now)
    demote = ((F.col("tier") == "hot") & (idle > HOT_IDLE_S) & (F.col("uses") < HOT_USES)) | ((F.col("tier") == "warm") & (idle > COLD_IDLE_S) & (F.col("uses") < WARM_USES))
    promote = (F.col("tier") != "hot") & (F.col("uses") >= WARM_USES) & (idle <= WARM_IDLE_S)
    return stats.select("key", "tier", F.when(demote, "demote").when(promote, "promote").otherwise("stay").alias("move"))


def window_frequency(least: int, percent: int) -> int:
    """The least frequency that keeps a key in the window, at least 1."""
    return max(1, (least * percent + 99) // 100)


def frequency(estimate: Column, uses: Column) -> Column:
    """A sketch's estimate, or the uses up to its cap where it has none."""
    return F.when(F.coalesce(estimate, F.lit(0)) == 0, F.least(uses, F.lit(255))).otherwise(estimate)


def utility(now: int) -> Column:
    """What keeping a key is worth: uses against idle hours, size in KB and recent writes."""
    hours = lambda us: (F.lit(now) - F.col(us)) / F.lit(3_600_000_000.0)
    write = F.lit(1.0) / (1 + F.coalesce(hours("write_us"), hours("last_us")))
    return WEIGHTS["uses"] * F.log1p("uses") - WEIGHTS["idle"] * hours("last_us") - WEIGHTS["size"] * F.col("size") / 1024 - WEIGHTS["write"] * write


def cost_policy(stats: DataFrame, now: int, protected: int = 10, percent: int = 20, idle: int = HOT_IDLE_S, estimates: DataFrame | None = None) -> DataFrame:
    """Hot keys that are idle and rarely used go down, warm ones that are worth little too; what is used enough goes up.

    estimates (key, estimate) are a sketch's frequencies; a key that it does not know has its own uses.
    """
    low = window_frequency(protected, percent)
    estimate = F.lit(0)
    if estimates is not None:
        stats, estimate = stats.join(estimates.select("key", "estimate"), "key", "left"), F.col("estimate")
    f = frequency(estimate, F.col("uses"))
    down = (F.col("tier") == "hot") & (idle_s(now) > idle) & ((f <= low) | (f < protected))
    down = down | ((F.col("tier") == "warm") & (utility(now) <= DEMOTE_AT))
    up = (F.col("tier") != "hot") & (f >= protected)
    return stats.select("key", "tier", F.round(utility(now), 6).alias("utility"), F.when(up, "promote").when(down, "demote").otherwise("stay").alias("move"))


def migration_plan(stats: DataFrame, now: int, batch: int = 100, budget: int | None = None, policy=None) -> DataFrame:
    """The demotions of one run: of each tier the ``batch`` idlest keys, and of those as many as the bytes allow.

    ``policy`` is ``default_policy`` or, as the reference's server has it, ``cost_policy``.
    """
    moves = (policy or default_policy)(stats, now).where("move = 'demote'").select("key")
    w = Window.partitionBy("tier").orderBy("last_us", "key")
    plan = stats.join(moves, "key", "left_semi").withColumn("n", F.row_number().over(w)).where(F.col("n") <= batch)
    plan = plan.withColumn("total", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))  # at most ``batch`` rows a tier
    if budget is not None:
        plan = plan.where(F.col("total") <= budget)
    return plan.select("key", "tier", F.col("n").cast("long").alias("n"), F.col("total").alias("total_bytes"))


def read_through(tiers: list[DataFrame]) -> DataFrame:
    """The value of each key in the first tier that has it; tiers: key, value, from hot to cold."""
    rows = None
    for rank, df in enumerate(tiers):
        part = df.select("key", "value", F.lit(rank).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("key").agg(F.min_by("value", "rank").alias("value"), F.min("rank").alias("tier"))


def load_missing(hot: DataFrame, warm: DataFrame) -> DataFrame:
    """The hot tier with what only the warm one has."""
    return hot.unionByName(warm.join(hot.select("key"), "key", "left_anti"))


def tier_keys(tiers: list[DataFrame]) -> DataFrame:
    """Every key of any tier, once."""
    return read_through(tiers).select("key")


def tier_sizes(tiers: list[DataFrame]) -> DataFrame:
    """Keys in all tiers: each once, and as the sum of the tiers' sizes, which counts a key in two of them twice."""
    rows = None
    for df in tiers:
        part = df.select("key")
        rows = part if rows is None else rows.unionByName(part)
    each = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("summed"))


def delete(tiers: list[DataFrame], keys: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """DEL in all tiers: what each keeps, and one row with how many keys went and the sum of what went from each tier."""
    gone = keys.select("key").distinct()
    left = [df.join(gone, "key", "left_anti") for df in tiers]
    rows = None
    for df in tiers:
        part = df.join(gone, "key", "left_semi").select("key")
        rows = part if rows is None else rows.unionByName(part)
    each = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return left, each.agg(F.count(F.lit(1)).alias("deleted"), F.coalesce(F.sum("n"), F.lit(0)).alias("summed"))


def rollup(stats: DataFrame) -> DataFrame:
    """Keys and bytes by tier and type, by tier, and in all (an extension); "all" stands for what is summed over."""
    out = stats.rollup("tier", "type").agg(F.count(F.lit(1)).alias("keys"), F.sum("size").alias("bytes"))
    return out.select(F.coalesce("tier", F.lit("all")).alias("tier"), F.coalesce("type", F.lit("all")).alias("type"), "keys", "bytes")


def demote_rows(entries: DataFrame, moves: DataFrame, now: int) -> DataFrame:
    """entries: key, tier, type, value, expire_at_us. Rows after a run's moves, with their type and expiry; those that have expired don't move."""
    live = F.col("expire_at_us").isNull() | (F.col("expire_at_us") >= now)
    joined = entries.join(moves.where("move <> 'stay'").select("key", "move"), "key", "left")
    down = F.when(F.col("tier") == "hot", "warm").otherwise("cold")
    tier = F.when(live & (F.col("move") == "demote"), down).when(live & (F.col("move") == "promote"), "hot").otherwise(F.col("tier"))
    return joined.withColumn("tier", tier).drop("move")


def moved(stats: DataFrame, moves: DataFrame) -> DataFrame:
    """Statistics after a run's moves (key, move): hot to warm or warm to cold, and anything promoted to hot."""
    joined = stats.join(moves.select("key", "move"), "key", "left")
    down = F.when(F.col("tier") == "hot", "warm").otherwise("cold")
    tier = F.when(F.col("move") == "demote", down).when(F.col("move") == "promote", "hot").otherwise(F.col("tier"))
    return joined.withColumn("tier", tier).drop("move")


def tier_report(stats: DataFrame, moves: DataFrame) -> DataFrame:
    """One row: keys and bytes of each tier, in all, and moves up and down."""
    kinds = ("hot", "warm", "cold")
    cells = [c for t in kinds for c in (F.count_if(F.col("tier") == t).alias(f"{t}_keys"), F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("size"))), F.lit(0)).alias(f"{t}_bytes"))]
    ways = [F.count_if(F.col("move") == "promote").alias("up"), F.count_if(F.col("move") == "demote").alias("down")]
    return stats.join(moves.select("key", "move"), "key", "left").agg(*cells, F.count(F.lit(1)).alias("keys"), *ways)
