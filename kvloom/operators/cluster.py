"""Slots, routing, hot slots, rebalancing, membership and failover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvloom.functions.slots import SLOTS, slot


def with_slot(df: DataFrame, key: str = "key") -> DataFrame:
    return df.withColumn("slot", slot(F.col(key)))


def slot_counts(keys: DataFrame) -> DataFrame:
    return with_slot(keys).groupBy("slot").agg(F.count(F.lit(1)).alias("keys"))


def keys_in_slot(keys: DataFrame, number: int, n: int) -> DataFrame:
    return with_slot(keys).where(F.col("slot") == number).orderBy("key").limit(n).select("key")


def key_for_slot(spark: SparkSession, number: int, most: int = 1_000_000) -> DataFrame:
    """The first of key-0, key-1, ... in the slot."""
    keys = spark.range(most).select("id", F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"))
    return with_slot(keys).where(F.col("slot") == number).orderBy("id").limit(1).select("key")


def cross_slot(requests: DataFrame) -> DataFrame:
    """requests: request, key. Whether all keys of a request share a slot."""
    return with_slot(requests).groupBy("request").agg((F.min("slot") != F.max("slot")).alias("crossed"), F.min("slot").alias("slot"))


def route(commands: DataFrame, slots: DataFrame, me: str) -> DataFrame:
    """commands: request, slot, asking; slots: slot, owner, state, target.

    LOCAL at the owner or, when asking, at a slot's importer; ASK while its keys move away; else MOVED.
    """
    joined = commands.join(slots, "slot", "left")
    own = F.col("owner") == me
    answer = (
        F.when(F.col("owner").isNull(), F.lit("CLUSTERDOWN"))
        .when(own & (F.col("state") == "exporting"), F.concat(F.lit("ASK "), "target"))
        .when(own, F.lit("LOCAL"))
        .when((F.col("state") == "importing") & F.col("asking"), F.lit("LOCAL"))
        .otherwise(F.concat(F.lit("MOVED "), F.col("slot").cast("string"), F.lit(" "), "owner"))
    )
    return joined.select("request", "slot", answer.alias("answer"))


def slot_ranges(slots: DataFrame) -> DataFrame:
    """Runs of neighbouring slots of one owner: what is the same for a run is the slot less its number among the owner's."""
    w = Window.partitionBy("owner").orderBy("slot")
    runs = slots.withColumn("run", F.col("slot") - F.row_number().over(w))
    return runs.groupBy("owner", "run").agg(F.min("slot").alias("first"), F.max("slot").alias("last"), F.count(F.lit(1)).alias("slots")).drop("run")


def even_plan(spark: SparkSession, nodes: list[str]) -> DataFrame:
    """Equal runs of slots over the sorted nodes; the first ones take what is left over."""
    base, extra = divmod(SLOTS, len(nodes))
    rows, at = [], 0
    for i, node in enumerate(sorted(nodes)):
        size = base + (i < extra)
        rows.append((node, at, at + size - 1))
        at += size
    return spark.createDataFrame(rows, "owner string, first int, last int")


def expand(ranges: DataFrame) -> DataFrame:
    return ranges.select("owner", F.explode(F.sequence("first", "last")).alias("slot"))


def parse_plan(plan: DataFrame) -> DataFrame:
    """plan: span ("a-b" or "a"), owner."""
    ends = F.split("span", "-")
    return plan.select("owner", F.trim(ends[0]).cast("int").alias("first"), F.trim(F.element_at(ends, -1)).cast("int").alias("last"))


def plan_moves(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Slots whose owner is not the one that is wanted."""
    w = wanted.select("slot", F.col("owner").alias("target"))
    moved = w.join(current.select("slot", F.col("owner").alias("source")), "slot", "left")
    return moved.where(F.col("source").isNull() | (F.col("source") != F.col("target"))).select("slot", "source", "target")


def hot_slots(traffic: DataFrame, factor: float = 3.0, least: float = 100.0, top: int = 20, warm_up: int = 10) -> DataFrame:
    """traffic: slot, tick, requests, bytes, one row for each slot that is active in a tick.

    A slot is hot in a tick if its requests are over ``factor`` times the mean of the active slots, once the mean
    is at least ``least`` and ``warm_up`` ticks are over; the ``top`` ones by score are told. The mean comes from a
    partial aggregation, so a tick's slots are brought together only to be ranked.
    """
    mean = traffic.groupBy("tick").agg(F.avg("requests").alias("mean"))
    hot = traffic.join(mean, "tick").where((F.col("mean") >= least) & (F.col("requests") > factor * F.col("mean")) & (F.col("tick") >= warm_up))
    hot = hot.withColumn("score", F.col("requests") / F.col("mean"))
    w = Window.partitionBy("tick").orderBy(F.desc("score"), "slot")
    return hot.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).select("tick", "slot", "requests", "bytes", "score", F.col("n").cast("long").alias("n"))


def baseline(traffic: DataFrame, ticks: int, alpha: float = 0.1) -> DataFrame:
    """The exponentially weighted mean of each slot's requests over ticks 0 to ticks - 1; idle ticks count as none."""
    by = traffic.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct(F.col("tick").cast("int"), F.col("requests").cast("double")))).alias("by"))
    fold = F.aggregate(F.sequence(F.lit(0), F.lit(ticks - 1)), F.lit(0.0), lambda acc, t: acc * (1 - alpha) + alpha * F.coalesce(F.try_element_at("by", t), F.lit(0.0)))
    return by.select("slot", fold.alias("baseline"))


def sticky(hot: DataFrame, run: int = 5, score: float = 5.0) -> DataFrame:
    """Slots that were hot in at least ``run`` ticks on end with such a score. Slot 0 is never told."""
    w = Window.partitionBy("slot").orderBy("tick")
    runs = hot.where((F.col("score") >= score) & (F.col("slot") != 0)).withColumn("island", F.col("tick") - F.row_number().over(w))
    runs = runs.groupBy("slot", "island").agg(F.min("tick").alias("first"), F.max("tick").alias("last"), F.count(F.lit(1)).alias("ticks"), F.max("score").alias("score"))
    return runs.where(F.col("ticks") >= run).drop("island")


def cooled(picks: DataFrame, most: int, cooldown: int = 30) -> DataFrame:
    """picks: slot, tick, in ticks 0 to most - 1. Of each slot, those that are more than ``cooldown`` ticks after the last one that counted.

    Which counts depends on the one before, so a slot's ticks are folded in order; there are ``most`` at most.
    """
    ticks = picks.groupBy("slot").agg(F.sort_array(F.collect_set(F.col("tick").cast("int"))).alias("ticks"))
    start = F.struct(F.lit(-cooldown - 1).alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, t: Column) -> Column:
        counts = t - acc["last"] > cooldown
        return F.struct(F.when(counts, t).otherwise(acc["last"]).alias("last"), F.when(counts, F.concat(acc["kept"], F.array(t))).otherwise(acc["kept"]).alias("kept"))

    folded = F.aggregate(F.filter("ticks", lambda t: (t >= 0) & (t < most)), start, step, lambda acc: acc["kept"])
    return ticks.select("slot", F.explode(folded).alias("tick"))


def owners_by_range(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """keys: key, slot; ranges: first, last, owner. Each key's owner, by a range join on at most 16,384 ranges."""
    r = ranges.select("first", "last", "owner")
    return keys.join(F.broadcast(r), F.col("slot").between(F.col("first"), F.col("last"))).select("key", "slot", "owner")


def drain_slots(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """entries: key, slot, node; moves: slot, target. The entries after whole slots have moved."""
    return entries.join(moves.select("slot", "target"), "slot", "left").select("key", "slot", F.coalesce("target", "node").alias("node"))


def greedy_plan(hot: DataFrame, loads: DataFrame, me: str, top: int = 2) -> DataFrame:
    """hot: slot, qps, score (here); loads: node, qps. At most ``top`` slots move, the first by score, each to the node
    with the least load, if that is then no more than here; loads follow every move.

    It is a fold over at most ``top`` slots and the nodes of a cluster, so it is unrolled into joins with one row.
    """
    picks = hot.orderBy(F.desc("score"), "slot").limit(top)
    picks = picks.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "slot")))  # ``top`` rows
    loads = loads.select("node", F.col("qps").cast("double").alias("load"))
    out = None
    for n in range(1, top + 1):
        pick = picks.where(F.col("n") == n).select("slot", F.col("qps").cast("double").alias("qps"))
        here = loads.where(F.col("node") == me).agg(F.max("load").alias("here"))
        least = loads.where(F.col("node") != me).orderBy("load", "node").limit(1).select(F.col("node").alias("target"), F.col("load").alias("there"))
        move = pick.crossJoin(here).crossJoin(least).where(F.col("there") + F.col("qps") <= F.col("here") - F.col("qps")).select("slot", F.lit(me).alias("source"), "target", "qps")
        moved = loads.join(F.broadcast(move), (F.col("node") == F.col("target")) | (F.col("node") == F.col("source")), "left")
        change = F.when(F.col("node") == F.col("target"), F.col("qps")).when(F.col("node") == F.col("source"), -F.col("qps")).otherwise(F.lit(0.0))
        loads = moved.select("node", (F.col("load") + change).alias("load"))
        out = move if out is None else out.unionByName(move)
    return out


def failures(reports: DataFrame, now: int, masters: int, silence_us: int = 15_000_000, window_us: int = 30_000_000) -> DataFrame:
    """reports: node, reporter, pong_us, us. PFAIL after silence; FAIL if most masters have reported it of late."""
    silent = F.max("pong_us") < now - silence_us
    late = F.count_distinct(F.when(F.col("us") >= now - window_us, F.col("reporter")))
    state = F.when(silent & (late >= masters // 2 + 1), "FAIL").when(silent, "PFAIL").otherwise("OK")
    return reports.groupBy("node").agg(state.alias("state"), late.alias("reporters"))


def owners(claims: DataFrame) -> DataFrame:
    """claims: slot, owner, epoch, seq. The claim with the highest epoch wins; of equal ones the first, and 0 only where nothing else is."""
    return claims.groupBy("slot").agg(F.max_by("owner", F.struct(F.col("epoch"), -F.col("seq"))).alias("owner"), F.max("epoch").alias("epoch"))


def best_replica(replicas: DataFrame) -> DataFrame:
    """replicas: slot, node, healthy, lsn, pos. The healthy one that has matched the most; of equal ones the first listed."""
    ok = replicas.where("healthy")
    return ok.groupBy("slot").agg(F.max_by("node", F.struct(F.col("lsn"), -F.col("pos"))).alias("node"), F.max("lsn").alias("lsn"))


def promote(slots: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen replica owns the slot, one epoch later; its next LSN follows what it has and what was known."""
    c = chosen.select("slot", F.col("node").alias("new"), F.col("lsn").alias("matched"))
    joined = slots.join(c, "slot", "left")
    taken = F.col("new").isNotNull()
    return joined.select(
        "slot",
        F.coalesce("new", "owner").alias("owner"),
        F.when(taken, F.col("owner")).alias("replica"),
        (F.col("epoch") + F.when(taken, 1).otherwise(0)).alias("epoch"),
        F.when(taken, F.greatest(F.col("next_lsn"), F.col("matched") + 1)).otherwise(F.col("next_lsn")).alias("next_lsn"),
    )


def overview(slots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Slots of each node, with its role and health."""
    n = slots.groupBy(F.col("owner").alias("node")).agg(F.count(F.lit(1)).alias("slots"))
    return nodes.join(n, "node", "left").select("node", "role", "healthy", F.coalesce("slots", F.lit(0)).alias("slots"))


def even_owner(number: Column, nodes: int) -> Column:
    """The node, from 0, of a slot in an even plan."""
    base, extra = divmod(SLOTS, nodes)
    return F.when(number < extra * (base + 1), F.floor(number / (base + 1))).otherwise(extra + F.floor((number - extra * (base + 1)) / base)).cast("long")


def slot_changes(slots: DataFrame, commands: DataFrame) -> DataFrame:
    """slots (slot, owner, state, target) after ADDSLOTS and SETSLOT, the last command of each slot deciding.

    commands: slot, op, node, seq. NODE and ADD give the slot to the node, MIGRATING and IMPORTING name where its
    keys go or come from, STABLE ends that. DEL changes nothing.
    """
    last = commands.where("op <> 'DEL'").groupBy("slot").agg(F.max_by(F.struct("op", "node"), "seq").alias("c"))
    j = slots.join(last, "slot", "left")
    op, node = F.col("c.op"), F.col("c.node")
    given = op.isin("NODE", "ADD")
    state = F.when(op == "MIGRATING", "exporting").when(op == "IMPORTING", "importing").when(op.isNotNull(), "stable").otherwise(F.col("state"))
    target = F.when(op.isin("MIGRATING", "IMPORTING"), node).when(op.isNull(), F.col("target"))
    return j.select("slot", F.when(given, node).otherwise(F.col("owner")).alias("owner"), state.alias("state"), target.alias("target"))


def info(slots: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: slots that have an owner, that are fine and that fail, nodes, and masters with slots."""
    health = nodes.select(F.col("node").alias("owner"), "healthy")
    j = slots.join(health, "owner", "left")
    ok = F.coalesce("healthy", F.lit(False))
    counted = j.agg(F.count("owner").alias("assigned"), F.count_if(ok).alias("ok"), F.count_if(F.col("owner").isNotNull() & ~ok).alias("fail"), F.count_distinct("owner").alias("size"))
    return counted.join(nodes.agg(F.count(F.lit(1)).alias("known")), F.lit(True))  # one row each
