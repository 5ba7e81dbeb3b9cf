"""Fixed cases of single operators, and folds against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kvloom.functions import globs, numbers, slots
from kvloom.operators import cluster, expiry, hashes, keys, lists, pastes, repllog, sets, sketches, strings, tiering, zsets
from kvloom.plans import catalogue
from kvloom.sources import codec


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# ---- functions


@pytest.mark.parametrize(
    ("key", "want"),
    [("foo", 12182), ("bar", 5061), ("hello", 866), ("{}", 0), ("{}foo", 0), ("{user}:123", 5474), ("{{foo}}", 13308), ("{a}{b}", 15495), ("{foo", 13308), ("}foo{bar", 7622)],
)
def test_slots(spark, key, want):
    assert spark.createDataFrame([(key,)], "k string").select(slots.slot(F.col("k"))).first()[0] == want


def test_crc(spark):
    rows = spark.createDataFrame([("",), ("123456789",), (None,)], "k string").select(slots.crc16(F.col("k"))).collect()
    assert [r[0] for r in rows][:2] == [0, 0x31C3] and len(slots.crc_table()) == 256


@pytest.mark.parametrize(
    ("glob", "key", "want"),
    [
        ("*", "a/b", True), ("a*", "a/b", False), ("a*", "abc", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False),
        ("[^a-c]x", "dx", True), ("\\*x", "*x", True), ("\\*x", "ax", False), ("[", "[", False), ("a[", "a", False), ("[]a]", "]", False), ("[\\]a]", "]", True), ("a.c", "abc", False), ("x\\", "x", False), ("user:*", "user:1", True),
    ],
)
def test_globs(spark, glob, key, want):
    assert spark.createDataFrame([(key,)], "k string").where(globs.matches(F.col("k"), glob)).count() == want


def test_number_text(spark):
    cases = {3.0: "3", 0.25: "0.25", 1e20: "100000000000000000000", 1.5e-7: "0.00000015", -2.0: "-2", 1e21: "1000000000000000000000", 123456.789: "123456.789", 0.1: "0.1", 1e7: "10000000", 1.25e9: "1250000000"}
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    assert [r[0] for r in df.select(numbers.plain_double(F.col("x"))).collect()] == list(cases.values())


# ---- values


def log(spark, rows, columns):
    return spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], f"{columns}, us long, seq long")


def test_strings(spark):
    writes = log(spark, [("a", "1"), ("b", ""), ("a", "2"), ("b", "x")], "key string, value string")
    assert values(strings.last_write(writes), "key", "value") == [("a", "2"), ("b", "x")]
    assert values(strings.first_write(writes), "key", "value") == [("a", "1"), ("b", "")]
    assert [r.old for r in strings.getset(writes).orderBy("seq").collect()] == [None, None, "1", None]
    assert values(strings.append(writes), "key", "value") == [("a", "12"), ("b", "x")]
    assert values(strings.strlen(spark.createDataFrame([("k", "é")], "key string, value string")), "bytes") == [(2,)]
    there = spark.createDataFrame([("a", "0")], "key string, value string")
    assert values(strings.set_nx(there, writes), "key", "value") == [("b", "")]
    assert values(strings.set_xx(there, writes), "key", "value") == [("a", "2")]
    request = spark.createDataFrame([(0, "a"), (1, "none"), (2, "a")], "pos int, key string")
    assert [r.value for r in strings.mget(there, request).orderBy("pos").collect()] == ["0", None, "0"]


def test_hashes(spark):
    rows = hashes.hset(log(spark, [("h", "b", "1"), ("h", "a", "2"), ("h", "b", "3")], "key string, field string, value string"))
    assert values(hashes.hgetall(rows), "pairs", "fields", "vals") == [("a=2,b=3", "a,b", "2,3")]
    gone = spark.createDataFrame([("h", "a"), ("h", "b"), ("h", "c")], "key string, field string")
    assert hashes.hdel(rows, gone).count() == 0 and values(hashes.hdel_count(rows, gone), "deleted") == [(2,)]


def test_list_ranges(spark):
    rows = spark.createDataFrame([("k", i, str(i)) for i in range(5)], "key string, i long, value string")
    for start in range(-7, 7):
        for stop in (-6, -2, 0, 3, 9):
            n = 5
            first, last = max(start + n if start < 0 else start, 0), min(stop + n if stop < 0 else stop, n - 1)
            assert values(lists.lrange(rows, start, stop), "i", "value") == [(i - first, str(i)) for i in range(first, last + 1)]
    assert values(lists.lindex(rows, -5), "value") == [("0",)] and lists.lindex(rows, 5).count() == 0
    assert values(lists.lset(rows, 9, "x"), "value") == [(str(i),) for i in range(5)]


def test_left_pushes_come_first(spark):
    pushes = log(spark, [("k", "a", True), ("k", "b", False), ("k", "c", True), ("k", "d", False)], "key string, value string, left boolean")
    assert [r.value for r in lists.pushed(pushes).orderBy("i").collect()] == ["c", "a", "b", "d"]


@pytest.mark.parametrize("batch", [3, 10000])
def test_list_replay_is_the_fold(spark, batch):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(5)}", rng.choice(["LPUSH", "RPUSH", "LPOP", "RPOP"]), str(i)) for i in range(400)]
    want = defaultdict(list)
    for key, op, value in rows:
        if op == "LPUSH":
            want[key].insert(0, value)
        elif op == "RPUSH":
            want[key].append(value)
        elif want[key]:
            want[key].pop(0 if op == "LPOP" else -1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = values(lists.replay(log(spark, rows, "key string, op string, value string")), "key", "i", "value")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((k, i, v) for k, own in want.items() for i, v in enumerate(own))


def test_sets(spark):
    rows = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "b"), ("t", "b")], "key string, member string")
    assert values(sets.smembers(rows), "key", "i", "member") == [("s", 0, "a"), ("s", 1, "b"), ("t", 0, "b")]
    assert values(sets.inter(rows, "s", "t"), "member") == [("b",)] and values(sets.diff(rows, "s", "t"), "member") == [("a",)]
    assert values(sets.union(rows, "s", "t"), "member") == [("a",), ("b",)]


def test_sorted_sets(spark):
    rows = zsets.zadd(log(spark, [("z", "b", 2.0), ("z", "a", 1.0), ("z", "n", float("nan")), ("z", "c", 2.0)], "key string, member string, score double"))
    assert [r.member for r in zsets.top(rows, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r.member for r in zsets.top(rows, 3, descending=True).orderBy("rank").collect()] == ["c", "b", "a"]
    assert values(zsets.zcount(rows, 1.0, 1.5), "members") == [(1,)] and values(zsets.zcard(rows), "members") == [(3,)]


def test_keys(spark):
    space = spark.createDataFrame([("a", "string"), ("b", "hash"), ("c", "set")], "key string, type string")
    renames = spark.createDataFrame([("a", "b"), ("x", "c")], "key string, newkey string")
    assert values(keys.rename(space, renames), "key", "type") == [("b", "string"), ("c", "set")]
    request = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x"), (2, "x")], "request int, key string")
    assert values(keys.exists(space, request), "request", "found") == [(1, 2), (2, 0)]
    assert [r.key for r in keys.scan_page(space, "a", 1).collect()] == ["b"]


def test_expiry(spark):
    space = spark.createDataFrame([("now", 100), ("past", 99), ("never", None), ("later", 2_500_100)], "key string, expire_at_us long")
    probes = spark.createDataFrame([("now",), ("past",), ("never",), ("later",), ("none",)], "key string")
    assert values(expiry.visible(space, 100), "key") == [("later",), ("never",), ("now",)]
    assert values(expiry.ttl(space, probes, 100), "key", "ttl") == [("later", 2), ("never", -1), ("none", -2), ("now", 0), ("past", -2)]
    assert values(expiry.ttl(space, probes, 100, 1000, compat=True), "key", "ttl") == [("later", 2500), ("never", 0), ("none", -2000), ("now", 0), ("past", -2000)]
    wish = spark.createDataFrame([("now", 0), ("never", 5)], "key string, ttl_us long")
    assert dict(values(expiry.expire(space, wish, 100), "key", "expire_at_us")) == {"now": None, "never": 105, "later": 2_500_100}


# ---- tiers and frequencies


def test_policies(spark):
    assert [tiering.window_frequency(*x) for x in ((10, 20), (1, 1), (100, 1), (101, 1), (0, 50))] == [2, 1, 1, 2, 1]
    now = 10**12
    ago = lambda s: now - s * 1_000_000
    rows = [("a", 2, ago(400), "hot"), ("b", 100, ago(400), "hot"), ("c", 10, ago(10), "warm"), ("d", 2, ago(8000), "warm"), ("e", 3, ago(10), "cold")]
    stats = spark.createDataFrame([(k, u, us, None, 100, t) for k, u, us, t in rows], "key string, uses long, last_us long, write_us long, size long, tier string")
    assert dict(values(tiering.default_policy(stats, now), "key", "move")) == {"a": "demote", "b": "stay", "c": "promote", "d": "demote", "e": "stay"}
    assert dict(values(tiering.cost_policy(stats, now), "key", "move")) == {"a": "demote", "b": "stay", "c": "promote", "d": "stay", "e": "stay"}
    plan = tiering.migration_plan(stats, now, budget=100)
    assert values(plan, "key", "tier") == [("a", "hot"), ("d", "warm")]


def test_sketches(spark):
    rng = random.Random(2)
    rows = [(f"k{int(rng.expovariate(0.2))}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, us long")
    exact = defaultdict(int)
    for k, _ in rows:
        exact[k] += 1
    assert dict(values(sketches.capped_frequency(df), "key", "frequency")) == {k: min(n, 15) for k, n in exact.items()}
    sketch = spark.sparkContext._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytes(sketches.count_min(df).first()[0]))
    assert all(n <= sketch.estimateCount(k) <= n + 0.001 * 3000 + 3 for k, n in exact.items())
    approx, real = sketches.distinct_keys(df).first()
    assert real == len(exact) and abs(approx - real) <= 0.1 * real
    want = {}
    for k in exact:
        uses = 0
        for bucket in range(3):
            uses = (uses + sum(1 for key, us in rows if key == k and (3000 - us) // 1000 == 2 - bucket)) // 2
        want[k] = uses
    got = dict(values(sketches.decayed(df, 1000, 3, 3000), "key", "uses"))
    assert all(got.get(k, 0) == n for k, n in want.items())


# ---- cluster


def test_routes(spark):
    table = spark.createDataFrame([(1, "me", "stable", None), (2, "me", "exporting", "you"), (3, "you", "importing", None), (4, "you", "stable", None)], "slot int, owner string, state string, target string")
    asks = spark.createDataFrame([(i, s, a) for i, (s, a) in enumerate([(1, False), (2, False), (3, False), (3, True), (4, True), (5, False)])], "request int, slot int, asking boolean")
    got = dict(values(cluster.route(asks, table, "me"), "request", "answer"))
    assert got == {0: "LOCAL", 1: "ASK you", 2: "MOVED 3 you", 3: "LOCAL", 4: "MOVED 4 you", 5: "CLUSTERDOWN"}


def test_plans(spark):
    plan = cluster.even_plan(spark, ["b", "a", "c"])
    assert values(plan, "owner", "first", "last") == [("a", 0, 5461), ("b", 5462, 10922), ("c", 10923, 16383)]
    assert values(cluster.slot_ranges(cluster.expand(plan)), "owner", "first", "last") == values(plan, "owner", "first", "last")
    spans = spark.createDataFrame([("0-2", "x"), ("7", "y")], "span string, owner string")
    assert values(cluster.parse_plan(spans), "owner", "first", "last") == [("x", 0, 2), ("y", 7, 7)]


def test_hot_slots(spark):
    rows = [(s, t, 1000 if s == 5 else 100, 1) for t in range(20) for s in range(10)]
    traffic = spark.createDataFrame(rows, "slot int, tick int, requests long, bytes long")
    hot = cluster.hot_slots(traffic)
    assert values(hot, "tick", "slot") == [(t, 5) for t in range(10, 20)]
    assert values(cluster.sticky(hot), "slot", "first", "last") == [(5, 10, 19)]
    assert cluster.hot_slots(traffic, least=1000.0).count() == 0


def test_greedy_plan(spark):
    loads = spark.createDataFrame([("me", 100.0), ("a", 10.0), ("b", 20.0)], "node string, qps double")
    hot = spark.createDataFrame([(1, 30.0, 9.0), (2, 25.0, 8.0), (3, 50.0, 1.0)], "slot int, qps double, score double")
    assert values(cluster.greedy_plan(hot, loads, "me"), "slot", "target") == [(1, "a"), (2, "b")]
    tight = spark.createDataFrame([(1, 60.0, 9.0)], "slot int, qps double, score double")
    assert cluster.greedy_plan(tight, loads, "me").count() == 0


def test_failover(spark):
    replicas = spark.createDataFrame([(1, "a", True, 5, 0), (1, "b", True, 7, 1), (1, "c", True, 7, 2), (1, "d", False, 9, 3)], "slot int, node string, healthy boolean, lsn long, pos int")
    best = cluster.best_replica(replicas)
    assert values(best, "node", "lsn") == [("b", 7)]
    slots_df = spark.createDataFrame([(1, "m", 3, 5), (2, "m", 3, 5)], "slot int, owner string, epoch long, next_lsn long")
    assert values(cluster.promote(slots_df, best), "slot", "owner", "epoch", "next_lsn") == [(1, "b", 4, 8), (2, "m", 3, 5)]
    claims = spark.createDataFrame([(1, "x", 0, 0), (1, "y", 2, 1), (1, "z", 2, 2)], "slot int, owner string, epoch long, seq long")
    assert values(cluster.owners(claims), "owner", "epoch") == [("y", 2)]


# ---- replication


def test_what_a_replica_applies(spark):
    rows = [(1, 2, 1), (1, 2, 1), (1, 2, 3), (1, 1, 9), (1, 2, 2), (1, 3, 1), (2, 1, 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "slot int, epoch long, lsn long, seq long")
    assert values(repllog.dedupe(df), "seq") == [(0,), (2,), (5,), (6,)]
    assert values(repllog.dedupe(df, strict_gaps=True), "seq") == [(0,), (5,), (6,)]


def test_resync(spark):
    entries = spark.createDataFrame([(1, i) for i in range(5, 10)], "slot int, lsn long")
    asks = spark.createDataFrame([(1, 7, 3), (1, 7, 4), (1, 7, 9), (1, 7, 10), (1, 6, 9), (2, 7, 0), (2, 7, 1)], "slot int, epoch long, lsn long")
    got = [(r.slot, r.lsn, r.answer, r.missed) for r in repllog.psync(entries, asks, 7).collect()]
    assert sorted(got, key=str) == sorted([(1, 3, "FULLRESYNC", None), (1, 4, "CONTINUE", 5), (1, 9, "CONTINUE", 0), (1, 10, "FULLRESYNC", None), (1, 9, "FULLRESYNC", None), (2, 0, "CONTINUE", 0), (2, 1, "FULLRESYNC", None)], key=str)


# ---- service


@pytest.mark.parametrize("batch", [3, 10000])
def test_rate_limit_is_the_fold(spark, batch):
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(4)}", t, i) for i, t in enumerate(sorted(rng.randrange(1000) for _ in range(300)))]
    begin, n, want = {}, {}, {}
    for c, us, seq in rows:
        if c not in begin or us >= begin[c] + 50:
            begin[c], n[c] = us, 0
        n[c] += 1
        want[seq] = n[c] <= 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = dict(values(pastes.rate_limit(spark.createDataFrame(rows, "client string, us long, seq long"), 3, 50), "seq", "passed"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_paste_rules(spark):
    rows = [("a", "", "1h", 0, False), ("b", "x" * 65537, "1h", 0, False), ("c", "x", "2h", 0, False), ("d", "x", "7d", -1, False), ("e", "x", "7d", 1, True), ("f", "é" * 32768, "5m", 0, True)]
    got = values(pastes.validate(spark.createDataFrame(rows, "code string, content string, ttl string, max_views int, burn boolean")), "code", "result")
    assert [r for _, r in got] == ["empty", "too large", "bad ttl", "bad views", "exclusive", "ok"]


def test_snapshots(spark, tmp_path):
    space = spark.createDataFrame([("a", "1", 5), ("b", "2", 16000)], "key string, value string, slot int")
    codec.save(space, f"{tmp_path}/s")
    assert values(codec.load(spark, f"{tmp_path}/s"), "key", "value", "slot") == values(space, "key", "value", "slot")
    (tmp_path / "log.json").write_text('{"key": "a", "op": "SET", "args": ["1"], "us": 1, "seq": 2}\n')
    assert codec.read_commands(spark, f"{tmp_path}/log.json").first().args == ["1"]
    (tmp_path / "state.json").write_text('{"version": 1, "slots": [{"slot": 3, "owner": "n", "epoch": 2, "state": "stable"}]}')
    assert values(codec.cluster_state(spark, f"{tmp_path}/state.json"), "slot", "owner") == [(3, "n")]
    bad = spark.createDataFrame([("x", "9:{}"), ("y", "zz"), ("z", "0:{\"str\":\"v\"}")], "key string, payload string")
    assert values(codec.restore(bad), "key", "str") == [("z", "v")]


def test_rows_only_queries(spark, data):
    q = catalogue.queries()
    rows = {n: q[n](spark, data).collect() for n in ("list_push_pop_mixed", "rate_limit_fixed", "rebalance_plan", "cms_sketch_size", "distinct_approx")}
    assert len(rows["rate_limit_fixed"]) == spark.read.parquet(f"{data}/events.parquet").count()
    assert rows["list_push_pop_mixed"] and rows["cms_sketch_size"][0].bytes > 0


def test_delete_count_keeps_no_set_of_the_keys(spark):
    """Keys that are asked for twice count once, without being made distinct first."""
    from kvloom.operators import keys as K

    keyspace = spark.createDataFrame([("a", "string"), ("b", "hash"), ("c", "string")], "key string, type string")
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("x",)], "key string")
    out = K.delete_count(keyspace, asked)
    assert sorted(tuple(r) for r in out.collect()) == [("hash", 1), ("string", 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
