"""Numbers within a key, whatever share of the rows it has, and what is built on them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvloom.operators import cluster, observability, positions, repllog, sets, sketches, strings


@pytest.mark.parametrize("many", [100, 10**6])
def test_one_key_of_most_rows(spark, many):
    """200,000 rows of one key and a few of others, with ties in what is rough, nulls and repeated values."""
    rows = spark.range(200_000).select(F.lit("hot").alias("key"), F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double").alias("score"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("member"))
    rows = rows.unionByName(spark.createDataFrame([("a", 1.0, "x"), ("a", 1.0, "y"), ("b", None, "z")], "key string, score double, member string"))
    out = positions.numbered(rows, "key", [F.asc("score"), F.asc("member")], F.col("score"), "i", many).toPandas()
    assert len(out) == 200_003 and list(out.columns) == ["key", "score", "member", "i"]
    for key, own in out.groupby("key"):
        want = own.sort_values(["score", "member"])
        assert (want["i"].to_numpy() == np.arange(len(own))).all(), key


def test_prefixes_order_texts(spark):
    texts = ["", "a", "a\x00", "ab", "abcdefg", "abcdefgh", "b", "é", "日本", "zzzzzzzzzz"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", positions.prefix_number(F.col("t")).alias("n")).collect()
    numbers = [r.n for r in sorted(got, key=lambda r: r.t.encode())]
    assert numbers == sorted(numbers)


def test_members_of_a_large_set(spark, monkeypatch):
    monkeypatch.setattr(positions.numbered, "__defaults__", (50,))
    rng = random.Random(4)
    members = [f"{rng.randrange(10**6)}" for _ in range(2000)]
    rows = spark.createDataFrame([("k", m) for m in members], "key string, member string")
    got = {r.member: r.i for r in sets.smembers(rows).collect()}
    assert got == {m: i for i, m in enumerate(sorted(set(members)))}
    assert {r.member for r in sets.pop(rows, 3).collect()} | {r.member for r in sets.sample(rows, 3).collect()} == set(members)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantiles_are_exact(spark, q):
    rng = random.Random(7)
    rows = [(c, rng.choice([0.25, rng.random()])) for c in ["a"] * 3000 + ["b"] * 7 + ["c"] for _ in (0,)]
    got = {r.cmd: r.value for r in observability.quantile(spark.createDataFrame(rows, "cmd string, seconds double"), q, many=1000).collect()}
    for c in "abc":
        assert got[c] == pytest.approx(np.quantile([s for x, s in rows if x == c], q))


def test_get_tells_wrong_types(spark):
    keyspace = spark.createDataFrame([("s", "string", "v"), ("l", "list", None)], "key string, type string, value string")
    probes = spark.createDataFrame([("s",), ("l",), ("none",), ("s",)], "key string")
    got = sorted((r.key, r.value, r.error) for r in strings.get(keyspace, probes).collect())
    assert got == [("l", None, "WRONGTYPE"), ("none", None, None), ("s", "v", None), ("s", "v", None)]


def test_replay_of_all_operations(spark):
    log = [
        (1, "a", "SET", ["1"]), (1, "a", "EXPIRE", ["10"]), (1, "a", "RENAME", ["b"]), (1, "b", "HSET", ["f", "x"]), (1, "h", "HSET", ["f", "1", "g", "2"]), (1, "h", "HSET", ["f", "3"]),
        (1, "h", "PEXPIRE", ["0"]), (2, "c", "MSET", ["2"]), (2, "c", "EXPIREAT", ["0"]), (2, "none", "RENAME", ["d"]), (2, "e", "SET", ["5"]), (2, "e", "EXPIRE", ["1"]), (2, "e", "PERSIST", []), (2, "e", "GET", []),
    ]
    rows = [(s, k, op, args, 1000 + i, i) for i, (s, k, op, args) in enumerate(log)]
    df = spark.createDataFrame(rows, "slot int, key string, op string, args array<string>, us long, seq long")
    got = sorted((r.key, r.type, r.field or "", r.value, r.expire_us) for r in repllog.replay_all(df).collect())
    assert got == [("b", "string", "", "1", 1001 + 10_000_000), ("e", "string", "", "5", None), ("h", "hash", "f", "3", None), ("h", "hash", "g", "2", None)]
    assert repllog.replay_all(df.limit(0)).count() == 0


def test_cooldown(spark):
    picks = spark.createDataFrame([(1, t) for t in (0, 3, 6, 7, 20, 20)] + [(2, 5)], "slot int, tick int")
    assert sorted((r.slot, r.tick) for r in cluster.cooled(picks, 30, 5).collect()) == [(1, 0), (1, 6), (1, 20), (2, 5)]


def test_older_accesses_can_count(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1500), ("b", 2999)], "key string, us long")
    told = lambda **k: {r.key: r.uses for r in sketches.decayed(df, 1000, 2, 2999, **k).collect()}
    assert told() == {"a": 0, "b": 0}
    assert told(older=True) == {"a": 0, "b": 0}
    many = df.unionByName(spark.range(40).select(F.lit("a").alias("key"), F.lit(0).cast("long").alias("us")))
    got = {r.key: r.uses for r in sketches.decayed(many, 1000, 2, 2999, older=True).collect()}
    assert got == {"a": 43 // 2 // 2, "b": 0}


def test_sketch_as_a_table(spark):
    """Estimates are never too small, and a key that was never seen has what its cells have."""
    rows = spark.createDataFrame([(f"k{i % 17}",) for i in range(500)], "key string")
    table = sketches.count_min_table(rows, 64, 3)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(20)], "key string")
    got = {r.key: r.estimate for r in sketches.estimated(table, keys, 64, 3).collect()}
    assert all(got[f"k{i}"] >= len(range(i, 500, 17)) for i in range(17)) and len(got) == 20
    assert table.count() <= 64 * 3
