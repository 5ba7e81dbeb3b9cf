"""The replication log: slot, epoch, lsn, op, key, args."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.operators import positions

#: Operations that replicas get.
REPLICATED = ("SET", "MSET", "HSET", "DEL", "RENAME", "EXPIRE", "PEXPIRE", "EXPIREAT", "PERSIST")
BACKLOG = 1024


def numbered(commands: DataFrame) -> DataFrame:
    """LSNs from 1 within each slot, in the log's order."""
    rows = positions.numbered(commands, "slot", [F.asc("us"), F.asc("seq")], F.col("us"), "lsn")
    return rows.withColumn("lsn", F.col("lsn") + 1)


def backlog(log: DataFrame, most: int = BACKLOG) -> DataFrame:
    """The last ``most`` operations of each slot."""
    w = Window.partitionBy("slot").orderBy(F.desc("lsn"))
    return log.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def after(log: DataFrame, slot: int, lsn: int) -> DataFrame:
    return log.where((F.col("slot") == slot) & (F.col("lsn") > lsn))


def psync(log: DataFrame, requests: DataFrame, epoch: int) -> DataFrame:
    """requests: slot, epoch, lsn. CONTINUE if the backlog has all that follows; else FULLRESYNC."""
    kept = log.groupBy("slot").agg(F.min("lsn").alias("first"), F.max("lsn").alias("last"))
    r = requests.join(kept, "slot", "left")
    can = F.when(F.col("last").isNull(), F.col("lsn") == 0).otherwise((F.col("lsn") <= F.col("last")) & (F.col("lsn") + 1 >= F.col("first")))
    answer = F.when((F.col("epoch") == epoch) & can, "CONTINUE").otherwise("FULLRESYNC")
    missed = F.when(answer == "CONTINUE", F.coalesce(F.col("last") - F.col("lsn"), F.lit(0)))
    return r.select("slot", "lsn", answer.alias("answer"), missed.cast("long").alias("missed"))


def dedupe(received: DataFrame, strict_gaps: bool = False) -> DataFrame:
    """What a replica applies of what it received in the order of ``seq``: operations of the newest epoch so far whose LSN is
    over all that it has applied of that epoch. With strict_gaps also nothing after a gap.
    """
    w = Window.partitionBy("slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fresh = received.withColumn("seen", F.max(F.struct("epoch", "lsn")).over(w))
    ok = F.col("seen").isNull() | (F.struct("epoch", "lsn") > F.col("seen"))
    out = fresh.where(ok).drop("seen")
    if strict_gaps:
        by = Window.partitionBy("slot", "epoch").orderBy("seq")
        gap = F.col("lsn") - F.lag("lsn").over(by) > 1
        broken = F.max(F.coalesce(gap, F.lit(False))).over(by)
        out = out.withColumn("broken", broken).where(~F.col("broken")).drop("broken")
    return out


def replay(log: DataFrame) -> DataFrame:
    """The strings after SET (key, value), DEL and again SET in turn: the last operation of each key, unless it is a DEL.

    ``replay_all`` does every replicated operation; this is the plan for logs of these two, a row a key and task.
    """
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value"), F.struct("us", "seq")).alias("last"))
    return last.where(F.col("last.op") != "DEL").select("key", "last.value")


def replay_all(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The keyspace after all replicated operations: a row a key and field (key, type, field, value, expire_us).

    log: slot, key, op, args (array of text), us, seq. SET and MSET take one value, HSET pairs of field and value, RENAME the new
    key, EXPIRE seconds and PEXPIRE milliseconds after ``us``, EXPIREAT seconds since 1970. A string's field is null. As the
    reference has it: a time of 0 or less takes the expiry away, EXPIREAT in the past deletes, SET and MSET replace any type
    and expiry, HSET on another type is refused, RENAME keeps type and expiry and replaces its target. A snapshot (slot and
    these columns) is what was there before.

    RENAME moves what a key has, so keys of one slot depend on each other, and on nothing else: rows are dealt and sorted by
    slot, and a task folds its slots as a stream and holds one slot's keys.
    """
    unknown = ~F.col("op").isin(*REPLICATED)
    rows = log.where(~unknown).select("slot", "key", "op", "args", "us", "seq", F.lit(None).cast("long").alias("expire_us"))
    if snapshot is not None:
        first = snapshot.select("slot", "key", F.concat(F.lit("."), "type").alias("op"), F.array("field", "value").alias("args"), F.lit(-(1 << 63)).alias("us"), F.lit(0).cast("long").alias("seq"), "expire_us")
        rows = first.unionByName(rows)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, keys = None, {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.slot != slot:
                    yield _held(keys)
                    slot, keys = row.slot, {}
                _apply(keys, row)
        yield _held(keys)

    dealt = rows.repartition("slot").sortWithinPartitions("slot", "us", "seq")
    return dealt.mapInPandas(fold, "key string, type string, field string, value string, expire_us long")


def _apply(keys: dict, row) -> None:
    """One operation on {key: [type, {field: value}, expiry or None]}."""
    op, key, args = row.op, row.key, list(row.args)
    own = keys.get(key)
    if op[0] == ".":
        kept = keys.setdefault(key, [op[1:], {}, None if pd.isna(row.expire_us) else int(row.expire_us)])
        kept[1][args[0]] = args[1]
    elif op in ("SET", "MSET"):
        keys[key] = ["string", {None: args[0]}, None]
    elif op == "HSET":
        if own is None or own[0] == "hash":
            keys.setdefault(key, ["hash", {}, None])[1].update(zip(args[0::2], args[1::2]))
    elif own is None:
        return
    elif op == "DEL":
        del keys[key]
    elif op == "RENAME":
        keys[args[0]] = keys.pop(key)
    elif op == "PERSIST":
        own[2] = None
    elif op == "EXPIREAT":
        own[2] = int(args[0]) * 1_000_000
        if own[2] <= row.us:
            del keys[key]
    else:
        us = int(args[0]) * (1_000_000 if op == "EXPIRE" else 1000)
        own[2] = row.us + us if us > 0 else None


def _held(keys: dict) -> pd.DataFrame:
    rows = [(key, kind, field, value, expiry) for key, (kind, fields, expiry) in keys.items() for field, value in fields.items()]
    out = pd.DataFrame(rows, columns=["key", "type", "field", "value", "expire_us"])
    return out.astype({"expire_us": "Int64"})


def acknowledged(acks: DataFrame) -> DataFrame:
    return acks.groupBy("slot", "node").agg(F.max("lsn").alias("lsn"))


def wait(acks: DataFrame, written: DataFrame) -> DataFrame:
    """How many nodes have each slot's last operation."""
    last = written.groupBy("slot").agg(F.max("lsn").alias("need"))
    return last.join(acknowledged(acks), "slot", "left").groupBy("slot", "need").agg(F.count_if(F.col("lsn") >= F.col("need")).alias("replicas"))


def status(log: DataFrame, acks: DataFrame) -> DataFrame:
    kept = log.groupBy("slot").agg(F.min("lsn").alias("first"), F.max("lsn").alias("last"))
    slowest = acknowledged(acks).groupBy("slot").agg(F.min("lsn").alias("slowest"))
    return kept.join(slowest, "slot", "left").select("slot", "first", "last", (F.col("last") - F.coalesce("slowest", F.lit(0))).alias("lag"))


def full_sync(snapshot: DataFrame, log: DataFrame, lsn: int) -> DataFrame:
    """The snapshot (key, value) with what the log has after it."""
    tail = log.where(F.col("lsn") > lsn)
    touched = tail.select("key").distinct()
    return snapshot.join(touched, "key", "left_anti").select("key", "value").unionByName(replay(tail))
