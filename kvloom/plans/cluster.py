"""Queries over slots, routing, replication, tiers, sketches and rebalancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions.slots import SLOTS, crc_table, slot
from kvloom.operators import cluster, repllog, sketches, tiering
from kvloom.plans.registry import LOG, NOW, query
from kvloom.sources import views as V

DAY = 86_400_000_000
TABLE = ", ".join(map(str, crc_table()))


def slot_sql(key: str) -> str:
    """The slot of a key without a tag; ``tab`` is the table of CRCs, a column that is joined."""
    return f"""CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 1 + length(hex(encode({key}))) // 2), lambda i: ('0x' || substr(hex(encode({key})), (2*i-1)::int, 2))::BIGINT)),
  lambda c, b: xor((c*256) & 65535, tab[(xor(c // 256, b) + 1)::int])) % {SLOTS} AS INTEGER)"""


#: A slot of every customer's key, every user's key and the log's rows.
TAB = f"tab AS (SELECT [{TABLE}]::BIGINT[] AS tab)"
CUST = f"WITH {TAB}, k AS (SELECT 'cust:' || c_custkey AS key, c_custkey, {slot_sql("'cust:' || c_custkey")} AS slot FROM customer, tab)"
SLOTTED = f"WITH {LOG}, {TAB}, u AS (SELECT key, {slot_sql('key')} AS slot FROM (SELECT DISTINCT key FROM log), tab), s AS (SELECT log.*, slot FROM log JOIN u USING (key))"


@query(f"{CUST} SELECT key, slot FROM k")
def slot_of_key(spark: SparkSession, d: str) -> DataFrame:
    return cluster.with_slot(V.customer_keys(spark, d).select("key"))


@query("SELECT * FROM (VALUES ('foo', 12182), ('bar', 5061), ('hello', 866), ('{}', 0), ('{}foo', 0), ('{user}:123', 5474), ('{{foo}}', 13308), ('{a}{b}', 15495), ('{foo', 13308), ('}foo{bar', 7622)) t(key, slot)")
def slot_of_tagged_key(spark: SparkSession, d: str) -> DataFrame:
    names = ["foo", "bar", "hello", "{}", "{}foo", "{user}:123", "{{foo}}", "{a}{b}", "{foo", "}foo{bar"]
    return cluster.with_slot(spark.createDataFrame([(n,) for n in names], "key string"))


@query(f"{CUST} SELECT slot, count(*) AS keys FROM k GROUP BY slot")
def slot_counts(spark: SparkSession, d: str) -> DataFrame:
    return cluster.slot_counts(V.customer_keys(spark, d))


@query(f"{CUST} SELECT key FROM k WHERE slot = (SELECT min(slot) FROM k) ORDER BY key LIMIT 10")
def slot_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = V.customer_keys(spark, d).select("key")
    least = cluster.with_slot(keys).agg(F.min("slot").alias("least"))
    return cluster.with_slot(keys).join(F.broadcast(least), F.col("slot") == F.col("least")).orderBy("key").limit(10).select("key")


@query(f"WITH {TAB}, k AS (SELECT num, 'key-' || num AS key, {slot_sql("'key-' || num")} AS slot FROM range(100000) t(num), tab) SELECT key FROM k WHERE slot = 866 ORDER BY num LIMIT 1")
def slot_find_key(spark: SparkSession, d: str) -> DataFrame:
    return cluster.key_for_slot(spark, 866, 100_000)


@query(f"{CUST}, r AS (SELECT c_custkey // 2 AS request, slot FROM k) SELECT request, min(slot) <> max(slot) AS crossed, min(slot) AS slot FROM r GROUP BY request")
def slot_crossslot(spark: SparkSession, d: str) -> DataFrame:
    keys = V.customer_keys(spark, d)
    return cluster.cross_slot(keys.select(F.floor(F.col("c_custkey") / 2).alias("request"), "key"))


NODES = 3


def _slots(spark: SparkSession) -> DataFrame:
    """Three nodes in even runs; every tenth slot is moving to the next node."""
    number = F.col("id")
    owner = cluster.even_owner(number, NODES)
    name = lambda c: F.concat(F.lit("node-"), c.cast("string"))
    state = F.when(number % 10 == 0, F.when(owner == 0, "exporting").otherwise("importing")).otherwise("stable")
    return spark.range(SLOTS).select(number.cast("int").alias("slot"), name(owner).alias("owner"), state.alias("state"), name((owner + 1) % NODES).alias("target"))


SLOT_TABLE = f"""slots AS (SELECT i::INTEGER AS slot, 'node-' || o AS owner, CASE WHEN i % 10 <> 0 THEN 'stable' WHEN o = 0 THEN 'exporting' ELSE 'importing' END AS state, 'node-' || ((o + 1) % 3) AS target
  FROM (SELECT i, CASE WHEN i < 5462 THEN i // 5462 ELSE 1 + (i - 5462) // 5461 END AS o FROM range(16384) t(i)))"""


@query(
    f"""{CUST}, {SLOT_TABLE} SELECT c_custkey AS request, k.slot, CASE WHEN owner = 'node-0' AND state = 'exporting' THEN 'ASK ' || target WHEN owner = 'node-0' THEN 'LOCAL'
WHEN state = 'importing' AND c_custkey % 2 = 0 THEN 'LOCAL' ELSE 'MOVED ' || k.slot || ' ' || owner END AS answer FROM k JOIN slots ON k.slot = slots.slot"""
)
def slot_route(spark: SparkSession, d: str) -> DataFrame:
    keys = cluster.with_slot(V.customer_keys(spark, d)).select(F.col("c_custkey").alias("request"), "slot", (F.col("c_custkey") % 2 == 0).alias("asking"))
    return cluster.route(keys, _slots(spark), "node-0")


@query(
    f"""WITH {SLOT_TABLE}, r AS (SELECT owner, slot, slot - row_number() OVER (PARTITION BY owner ORDER BY slot) AS run FROM slots WHERE slot % 100 <> 7)
SELECT owner, min(slot) AS first, max(slot) AS last, count(*) AS slots FROM r GROUP BY owner, run"""
)
def slot_ranges(spark: SparkSession, d: str) -> DataFrame:
    return cluster.slot_ranges(_slots(spark).where("slot % 100 <> 7"))


@query("SELECT * FROM (VALUES ('node-0', 0, 3276), ('node-1', 3277, 6553), ('node-2', 6554, 9830), ('node-3', 9831, 13107), ('node-4', 13108, 16383)) t(owner, first, last)")
def slot_plan_even(spark: SparkSession, d: str) -> DataFrame:
    return cluster.even_plan(spark, [f"node-{i}" for i in reversed(range(5))])


@query(f"WITH {SLOT_TABLE} SELECT slot, owner AS source, CASE WHEN slot <= 8191 THEN 'node-0' ELSE 'node-1' END AS target FROM slots WHERE owner <> CASE WHEN slot <= 8191 THEN 'node-0' ELSE 'node-1' END")
def slot_plan_diff(spark: SparkSession, d: str) -> DataFrame:
    plan = spark.createDataFrame([("0-8191", "node-0"), ("8192-16383", "node-1")], "span string, owner string")
    return cluster.plan_moves(_slots(spark), cluster.expand(cluster.parse_plan(plan)))


@query(f"WITH {SLOT_TABLE}, c AS (SELECT owner AS node, count(*) AS slots FROM slots GROUP BY 1) SELECT n AS node, r AS role, h AS healthy, coalesce(slots, 0) AS slots FROM (VALUES ('node-0', 'master', true), ('node-1', 'master', true), ('node-2', 'master', false), ('node-3', 'replica', true)) t(n, r, h) LEFT JOIN c ON n = node")
def cluster_overview(spark: SparkSession, d: str) -> DataFrame:
    nodes = [("node-0", "master", True), ("node-1", "master", True), ("node-2", "master", False), ("node-3", "replica", True)]
    return cluster.overview(_slots(spark), spark.createDataFrame(nodes, "node string, role string, healthy boolean"))


@query(f"WITH {SLOT_TABLE} SELECT owner AS node, string_agg(first || '-' || last, ' ' ORDER BY first) AS spans FROM (SELECT owner, min(slot) AS first, max(slot) AS last FROM slots GROUP BY owner) GROUP BY 1")
def cluster_nodes(spark: SparkSession, d: str) -> DataFrame:
    runs = cluster.slot_ranges(_slots(spark)).groupBy(F.col("owner").alias("node")).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("r"))  # runs of one node's slots
    return runs.select("node", F.array_join(F.transform("r", lambda x: F.concat(x["first"].cast("string"), F.lit("-"), x["last"].cast("string"))), " ").alias("spans"))


@query(
    f"""WITH {SLOT_TABLE}, c AS (SELECT (i * 7) % 16384 AS slot, i AS seq, CASE i % 6 WHEN 0 THEN 'ADD' WHEN 1 THEN 'NODE' WHEN 2 THEN 'MIGRATING' WHEN 3 THEN 'IMPORTING' WHEN 4 THEN 'STABLE' ELSE 'DEL' END AS op, 'node-' || (i % 4) AS node FROM range(3000) t(i)),
l AS (SELECT slot, arg_max(op, seq) AS op, arg_max(node, seq) AS node FROM c WHERE op <> 'DEL' GROUP BY slot)
SELECT slots.slot, CASE WHEN op IN ('ADD', 'NODE') THEN node ELSE owner END AS owner, CASE op WHEN 'MIGRATING' THEN 'exporting' WHEN 'IMPORTING' THEN 'importing' ELSE CASE WHEN op IS NULL THEN state ELSE 'stable' END END AS state,
  CASE WHEN op IN ('MIGRATING', 'IMPORTING') THEN node WHEN op IS NULL THEN target END AS target FROM slots LEFT JOIN l ON slots.slot = l.slot"""
)
def slot_changes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    op = F.get(F.array(*[F.lit(x) for x in ("ADD", "NODE", "MIGRATING", "IMPORTING", "STABLE", "DEL")]), (i % 6).cast("int"))
    commands = spark.range(3000).select((i * 7 % SLOTS).cast("int").alias("slot"), op.alias("op"), F.concat(F.lit("node-"), (i % 4).cast("string")).alias("node"), i.alias("seq"))
    return cluster.slot_changes(_slots(spark), commands)


@query("SELECT 16384::BIGINT AS assigned, 10923::BIGINT AS ok, 5461::BIGINT AS fail, 3::BIGINT AS size, 4::BIGINT AS known")
def cluster_info(spark: SparkSession, d: str) -> DataFrame:
    nodes = [("node-0", "master", True), ("node-1", "master", True), ("node-2", "master", False), ("node-3", "replica", True)]
    return cluster.info(_slots(spark), spark.createDataFrame(nodes, "node string, role string, healthy boolean"))


# ---- membership: nations report on suppliers


def _reports(spark: SparkSession, d: str) -> DataFrame:
    s = V.table(spark, d, "supplier")
    late = (F.col("s_suppkey") % 40).cast("long") * 1_000_000
    return s.select(F.concat(F.lit("n"), (F.col("s_suppkey") % 7).cast("string")).alias("node"), F.col("s_nationkey").alias("reporter"), (F.lit(V.NOW_US) - 15_000_000 + F.col("s_suppkey") % 7 * 1_000_000 - 3_000_000).alias("pong_us"), (F.lit(V.NOW_US) - late).alias("us"))


@query(
    f"""WITH r AS (SELECT 'n' || (s_suppkey % 7) AS node, s_nationkey AS reporter, {NOW} - 15000000 + s_suppkey % 7 * 1000000 - 3000000 AS pong_us, {NOW} - s_suppkey % 40 * 1000000 AS us FROM supplier),
g AS (SELECT node, max(pong_us) AS pong, count(DISTINCT CASE WHEN us >= {NOW} - 30000000 THEN reporter END) AS reporters FROM r GROUP BY node)
SELECT node, CASE WHEN pong < {NOW} - 15000000 AND reporters >= 6 THEN 'FAIL' WHEN pong < {NOW} - 15000000 THEN 'PFAIL' ELSE 'OK' END AS state, reporters FROM g"""
)
def gossip_failures(spark: SparkSession, d: str) -> DataFrame:
    return cluster.failures(_reports(spark, d), V.NOW_US, 10)


@query("SELECT CAST(o_custkey % 100 AS INTEGER) AS slot, arg_max('c' || o_custkey, (o_orderkey % 9, -o_orderkey)) AS owner, max(o_orderkey % 9) AS epoch FROM orders GROUP BY 1")
def gossip_owners(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    return cluster.owners(o.select((F.col("o_custkey") % 100).cast("int").alias("slot"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner"), (F.col("o_orderkey") % 9).alias("epoch"), F.col("o_orderkey").alias("seq")))


REPLICAS = "r AS (SELECT CAST(o_custkey % 100 AS INTEGER) AS slot, 'r' || o_orderkey AS node, o_orderstatus <> 'P' AS healthy, o_orderkey % 50 AS lsn, o_orderkey AS pos FROM orders)"


def _replicas(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 100).cast("int").alias("slot"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("node"), (F.col("o_orderstatus") != "P").alias("healthy"), (F.col("o_orderkey") % 50).alias("lsn"), F.col("o_orderkey").alias("pos"))


@query(f"WITH {REPLICAS} SELECT slot, arg_max(node, (lsn, -pos)) AS node, max(lsn) AS lsn FROM r WHERE healthy GROUP BY slot")
def failover_best_replica(spark: SparkSession, d: str) -> DataFrame:
    return cluster.best_replica(_replicas(spark, d))


@query(
    f"""WITH {REPLICAS}, {SLOT_TABLE}, b AS (SELECT slot, arg_max(node, (lsn, -pos)) AS node, max(lsn) AS lsn FROM r WHERE healthy GROUP BY slot)
SELECT slots.slot, coalesce(node, owner) AS owner, CASE WHEN node IS NOT NULL THEN owner END AS replica, CASE WHEN node IS NULL THEN 1::BIGINT ELSE 2 END AS epoch, CASE WHEN node IS NULL THEN 10::BIGINT ELSE greatest(10, lsn + 1) END AS next_lsn
FROM slots LEFT JOIN b ON slots.slot = b.slot"""
)
def failover_promote(spark: SparkSession, d: str) -> DataFrame:
    slots = _slots(spark).select("slot", "owner", F.lit(1).cast("long").alias("epoch"), F.lit(10).cast("long").alias("next_lsn"))
    return cluster.promote(slots, failover_best_replica(spark, d))


# ---- replication


def _repl(spark: SparkSession, d: str) -> DataFrame:
    rows = V.log(spark, d)
    slots = cluster.with_slot(rows.select("key").distinct())  # a key's slot once
    op = F.when(F.col("seq") % 11 == 0, "DEL").otherwise("SET")
    return repllog.numbered(rows.join(slots, "key").select("slot", F.lit(1).alias("epoch"), op.alias("op"), "key", F.col("op").alias("value"), "us", "seq"))


REPL = f"{SLOTTED}, r AS (SELECT slot, CASE WHEN seq % 11 = 0 THEN 'DEL' ELSE 'SET' END AS op, key, op AS value, us, seq, row_number() OVER (PARTITION BY slot ORDER BY us, seq) AS lsn FROM s)"


@query(f"{REPL} SELECT seq, slot, lsn FROM r")
def repl_lsn(spark: SparkSession, d: str) -> DataFrame:
    return _repl(spark, d).select("seq", "slot", "lsn")


@query(f"{REPL} SELECT slot, lsn, key, op FROM r QUALIFY row_number() OVER (PARTITION BY slot ORDER BY lsn DESC) <= 5")
def repl_bounded_tail(spark: SparkSession, d: str) -> DataFrame:
    return repllog.backlog(_repl(spark, d), 5).select("slot", "lsn", "key", "op")


@query(f"{REPL} SELECT key, arg_max(value, (us, seq)) AS value FROM r GROUP BY key HAVING arg_max(op, (us, seq)) <> 'DEL'")
def repl_replay(spark: SparkSession, d: str) -> DataFrame:
    return repllog.replay(_repl(spark, d))


#: A log of all replicated operations on a user's string and hash, which a tag keeps in one slot.
ALL_OPS = f"""WITH {LOG}, o AS (SELECT *, seq % 10 AS n, '{{user:' || user_id || '}}' AS tag FROM log),
g AS (SELECT *, sum(CASE WHEN n IN (0, 1, 3, 6, 7) THEN 1 ELSE 0 END) OVER (PARTITION BY tag ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS life FROM o WHERE n <> 2),
e AS (SELECT tag, life, arg_min(n, (us, seq)) AS first, arg_min(op, (us, seq)) AS value, min((us, seq)) AS at,
  arg_max(CASE n WHEN 4 THEN us + 5000000 WHEN 8 THEN us + 7000 WHEN 9 THEN {NOW} WHEN 5 THEN 0 END, (us, seq)) FILTER (n IN (4, 5, 8, 9)) AS expiry FROM g WHERE life > 0 GROUP BY tag, life),
x AS (SELECT *, lead(first) OVER (PARTITION BY tag ORDER BY life) AS after FROM e),
r AS (SELECT tag, arg_max(value, life) AS value, arg_max(coalesce(expiry, 0), life) AS expiry FROM x WHERE first IN (0, 1, 7) AND after = 6 GROUP BY tag)"""


@query(
    f"""{ALL_OPS} SELECT tag AS key, 'string' AS type, '' AS field, value, coalesce(expiry, 0) AS expire_us FROM x WHERE after IS NULL AND first IN (0, 1, 7)
UNION ALL SELECT tag || ':r', 'string', '', value, expiry FROM r
UNION ALL SELECT tag || ':h', 'hash', op, arg_max(txt, (us, seq)), 0 FROM o WHERE n = 2 GROUP BY tag, op"""
)
def repl_replay_all(spark: SparkSession, d: str) -> DataFrame:
    return _all_replayed(_all_ops(spark, d))


def _all_ops(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("seq") % 10).cast("int")
    names = F.array(*[F.lit(x) for x in ("SET", "SET", "HSET", "DEL", "EXPIRE", "PERSIST", "RENAME", "MSET", "PEXPIRE", "EXPIREAT")])
    tag = F.concat(F.lit("{user:"), F.col("user_id").cast("string"), F.lit("}"))
    args = F.when(n == 2, F.array("op", "text")).when(n == 4, F.array(F.lit("5"))).when(n == 6, F.array(F.concat(tag, F.lit(":r")))).when(n == 8, F.array(F.lit("7"))).when(n == 9, F.array(F.lit(str(NOW // 1_000_000)))).otherwise(F.array("op"))
    return V.log(spark, d).select(F.when(n == 2, F.concat(tag, F.lit(":h"))).otherwise(tag).alias("key"), F.get(names, n).alias("op"), args.alias("args"), "us", "seq").withColumn("slot", slot(F.col("key")))


def _all_replayed(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    return repllog.replay_all(log, snapshot).select("key", "type", F.coalesce("field", F.lit("")).alias("field"), "value", F.coalesce("expire_us", F.lit(0)).alias("expire_us"))


@query(
    f"""{ALL_OPS} SELECT tag AS key, 'string' AS type, '' AS field, value, coalesce(expiry, 0) AS expire_us FROM x WHERE after IS NULL AND first IN (0, 1, 7)
UNION ALL SELECT tag || ':r', 'string', '', value, expiry FROM r
UNION ALL SELECT tag || ':h', 'hash', op, arg_max(txt, (us, seq)), 0 FROM o WHERE n = 2 GROUP BY tag, op"""
)
def repl_full_sync_all(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of the first half of January, and the rest of the log on top of it: the same as the whole log."""
    ops = _all_ops(spark, d)
    half = V.NOW_US - 15 * DAY
    before = repllog.replay_all(ops.where(F.col("us") < half)).withColumn("slot", slot(F.col("key")))
    return _all_replayed(ops.where(F.col("us") >= half), before)


@query(f"{REPL} SELECT slot, CAST(e AS INTEGER) AS epoch, lsn FROM r, (VALUES (1), (2)) t(e) WHERE lsn % 5 <> 4 AND (e = 1 OR lsn <= 3)")
def repl_dedupe_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs one after the other, then what is late of the first; one operation in five never came."""
    r = _repl(spark, d).where("lsn % 5 <> 4").select("slot", "lsn")
    first = r.select("slot", F.lit(1).alias("epoch"), "lsn", F.col("lsn").alias("seq"))
    second = r.where("lsn <= 3").select("slot", F.lit(2).alias("epoch"), "lsn", (F.lit(1 << 40) + F.col("lsn")).alias("seq"))
    stale = r.select("slot", F.lit(1).alias("epoch"), (F.col("lsn") + 1_000_000).alias("lsn"), (F.lit(1 << 41) + F.col("lsn")).alias("seq"))
    return repllog.dedupe(first.unionByName(second).unionByName(stale)).select("slot", "epoch", "lsn")


@query(f"{REPL} SELECT slot, 1 AS epoch, lsn FROM r")
def repl_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every operation is sent twice, the second time after a pause; each is applied once."""
    once = _repl(spark, d).select("slot", "epoch", "lsn", "seq")
    sent = once.select("slot", "epoch", "lsn", F.explode(F.array(F.col("lsn") * 2, F.col("lsn") * 2 + 5)).alias("seq"))
    return repllog.dedupe(sent).select("slot", "epoch", "lsn")


ACKS = f"{REPL}, a AS (SELECT slot, 'node-' || n AS node, lsn FROM r, (VALUES (0), (1), (2)) t(n) WHERE lsn % (n + 1) = 0), g AS (SELECT slot, node, max(lsn) AS lsn FROM a GROUP BY slot, node)"


def _acks(spark: SparkSession, d: str) -> DataFrame:
    n = F.explode(F.sequence(F.lit(0), F.lit(2)))
    return _repl(spark, d).select("slot", "lsn", n.alias("n")).where("lsn % (n + 1) = 0").select("slot", F.concat(F.lit("node-"), F.col("n").cast("string")).alias("node"), "lsn")


@query(f"{ACKS} SELECT slot, node, lsn FROM g")
def repl_acks(spark: SparkSession, d: str) -> DataFrame:
    return repllog.acknowledged(_acks(spark, d))


@query(f"{ACKS}, m AS (SELECT slot, max(lsn) AS need FROM r GROUP BY slot) SELECT m.slot, need, count(*) FILTER (g.lsn >= need) AS replicas FROM m LEFT JOIN g ON m.slot = g.slot GROUP BY m.slot, need")
def repl_wait(spark: SparkSession, d: str) -> DataFrame:
    return repllog.wait(_acks(spark, d), _repl(spark, d))


@query(f"{ACKS}, m AS (SELECT slot, min(lsn) AS first, max(lsn) AS last FROM r GROUP BY slot), w AS (SELECT slot, min(lsn) AS slowest FROM g GROUP BY slot) SELECT m.slot, first, last, last - coalesce(slowest, 0) AS lag FROM m LEFT JOIN w ON m.slot = w.slot")
def repl_status(spark: SparkSession, d: str) -> DataFrame:
    return repllog.status(_repl(spark, d), _acks(spark, d))


@query(
    f"""{REPL}, b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY slot ORDER BY lsn DESC) <= 5), k AS (SELECT slot, min(lsn) AS first, max(lsn) AS last FROM b GROUP BY slot),
q AS (SELECT i::INTEGER AS slot, i % 3 AS epoch, i % 90 AS lsn FROM range(16384) t(i)), j AS (SELECT q.slot, q.lsn, CASE WHEN epoch = 1 AND CASE WHEN last IS NULL THEN q.lsn = 0 ELSE q.lsn <= last AND q.lsn + 1 >= first END THEN 'CONTINUE' ELSE 'FULLRESYNC' END AS answer, last FROM q LEFT JOIN k ON q.slot = k.slot)
SELECT slot, lsn, answer, CASE WHEN answer = 'CONTINUE' THEN coalesce(last - lsn, 0) ELSE -1 END AS missed FROM j"""
)
def repl_psync(spark: SparkSession, d: str) -> DataFrame:
    requests = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"), (F.col("id") % 3).alias("epoch"), (F.col("id") % 90).alias("lsn"))
    return repllog.psync(repllog.backlog(_repl(spark, d), 5), requests, 1).withColumn("missed", F.coalesce("missed", F.lit(-1)))


@query(
    f"""{REPL}, snap AS (SELECT key, arg_max(value, (us, seq)) AS value FROM r WHERE lsn <= 20 GROUP BY key HAVING arg_max(op, (us, seq)) <> 'DEL'), t AS (SELECT * FROM r WHERE lsn > 20)
SELECT key, value FROM snap WHERE key NOT IN (SELECT key FROM t) UNION ALL SELECT key, arg_max(value, (us, seq)) FROM t GROUP BY key HAVING arg_max(op, (us, seq)) <> 'DEL'"""
)
def repl_full_sync(spark: SparkSession, d: str) -> DataFrame:
    log = _repl(spark, d)
    return repllog.full_sync(repllog.replay(log.where("lsn <= 20")), log, 20)


# ---- tiers

STATS = f"""WITH {LOG}, t AS (SELECT key, count(*) AS uses, max(us) AS last_us, max(CASE WHEN op IN ('signup', 'purchase') THEN us END) AS write_us, CAST(arg_max(strlen(props), (us, seq)) AS BIGINT) AS size, any_value(user_id) AS u FROM log GROUP BY key),
stats AS (SELECT key, uses, last_us, write_us, size, CASE u % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier, floor(({NOW} - last_us) / 1000000) AS idle FROM t),
moves AS (SELECT *, CASE WHEN (tier = 'hot' AND idle > 300 AND uses < 100) OR (tier = 'warm' AND idle > 7200 AND uses < 10) THEN 'demote' WHEN tier <> 'hot' AND uses >= 10 AND idle <= 1800 THEN 'promote' ELSE 'stay' END AS move FROM stats)"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    rows = V.log(spark, d).select("key", "us", "seq", F.octet_length("props").cast("long").alias("bytes"), F.col("op").isin("signup", "purchase").alias("is_write"))
    number = F.substring("key", 6, 20).cast("long") % 3
    return tiering.access_stats(rows).withColumn("tier", F.when(number == 0, "hot").when(number == 1, "warm").otherwise("cold"))


@query(f"{STATS} SELECT tier, count(*) AS keys, CAST(sum(size) AS BIGINT) AS bytes FROM stats GROUP BY tier")
def tier_stats(spark: SparkSession, d: str) -> DataFrame:
    return tiering.by_tier(_stats(spark, d))


@query(f"{STATS} SELECT key, uses, last_us, coalesce(write_us, 0) AS write_us, size FROM stats")
def tier_access_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).drop("tier").withColumn("write_us", F.coalesce("write_us", F.lit(0)))


@query(f"{STATS} SELECT key FROM stats WHERE tier = 'hot' AND idle > 86400 AND uses < 12")
def tier_cold_keys(spark: SparkSession, d: str) -> DataFrame:
    return tiering.cold_keys(_stats(spark, d), V.NOW_US, 86400, 12)


@query(f"{STATS} SELECT key FROM stats WHERE tier <> 'hot' AND uses > 12")
def tier_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    return tiering.hot_keys(_stats(spark, d), 12)


@query(f"{STATS} SELECT key, tier, move FROM moves")
def tier_policy_default(spark: SparkSession, d: str) -> DataFrame:
    return tiering.default_policy(_stats(spark, d), V.NOW_US)


UTILITY = f"(1.0 * ln(1 + uses) - 0.4 * ({NOW} - last_us) / 3600000000.0 - 0.2 * size / 1024 - 0.2 * (1.0 / (1 + coalesce(({NOW} - write_us) / 3600000000.0, ({NOW} - last_us) / 3600000000.0))))"


@query(
    f"""{STATS} SELECT key, tier, round({UTILITY}, 6) AS utility, CASE WHEN tier <> 'hot' AND least(uses, 255) >= 10 THEN 'promote'
WHEN (tier = 'hot' AND idle > 300 AND (least(uses, 255) <= 2 OR least(uses, 255) < 10)) OR (tier = 'warm' AND {UTILITY} <= -0.5) THEN 'demote' ELSE 'stay' END AS move FROM stats"""
)
def tier_policy_cost(spark: SparkSession, d: str) -> DataFrame:
    return tiering.cost_policy(_stats(spark, d), V.NOW_US)


@query(
    f"""{STATS}, p AS (SELECT key, tier, row_number() OVER w AS n, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM moves WHERE move = 'demote' WINDOW w AS (PARTITION BY tier ORDER BY last_us, key))
SELECT key, tier, n, CAST(total AS BIGINT) AS total_bytes FROM p WHERE n <= 100 AND total <= 500"""
)
def tier_migration_plan(spark: SparkSession, d: str) -> DataFrame:
    return tiering.migration_plan(_stats(spark, d), V.NOW_US, 100, 500)


TIERS = f"WITH {LOG}, w AS (SELECT key, arg_max(op, (us, seq)) AS value, any_value(user_id) AS u FROM log GROUP BY key)"


def _tiers(spark: SparkSession, d: str) -> list[DataFrame]:
    last = V.str_rows(spark, d).groupBy("key").agg(F.max_by("value", V.place()).alias("value")).withColumn("u", F.substring("key", 6, 20).cast("long"))
    tagged = lambda df, tag: df.select("key", F.concat("value", F.lit(tag)).alias("value"))
    return [tagged(last.where("u % 2 = 0"), "@hot"), tagged(last.where("u % 3 = 0"), "@warm"), tagged(last, "@cold")]


@query(f"{TIERS} SELECT key, value || CASE WHEN u % 2 = 0 THEN '@hot' WHEN u % 3 = 0 THEN '@warm' ELSE '@cold' END AS value, CASE WHEN u % 2 = 0 THEN 0 WHEN u % 3 = 0 THEN 1 ELSE 2 END AS tier FROM w")
def tier_read_through(spark: SparkSession, d: str) -> DataFrame:
    return tiering.read_through(_tiers(spark, d))


@query(f"{TIERS} SELECT key, value || CASE WHEN u % 2 = 0 THEN '@hot' ELSE '@warm' END AS value FROM w WHERE u % 2 = 0 OR u % 3 = 0")
def tier_load_missing(spark: SparkSession, d: str) -> DataFrame:
    hot, warm, _ = _tiers(spark, d)
    return tiering.load_missing(hot, warm)


@query(f"{TIERS} SELECT key FROM w")
def tier_keys(spark: SparkSession, d: str) -> DataFrame:
    return tiering.tier_keys(_tiers(spark, d))


@query(f"{TIERS} SELECT count(*) AS keys, CAST(sum(1 + (u % 2 = 0)::INT + (u % 3 = 0)::INT) AS BIGINT) AS summed FROM w")
def tier_dbsize(spark: SparkSession, d: str) -> DataFrame:
    return tiering.tier_sizes(_tiers(spark, d))


@query(f"{STATS} SELECT key, CASE WHEN move = 'promote' THEN 'hot' WHEN move = 'demote' THEN CASE WHEN tier = 'hot' THEN 'warm' ELSE 'cold' END ELSE tier END AS tier FROM moves")
def tier_moved(spark: SparkSession, d: str) -> DataFrame:
    stats = _stats(spark, d)
    return tiering.moved(stats, tiering.default_policy(stats, V.NOW_US)).select("key", "tier")


@query(
    f"""{STATS} SELECT count(*) FILTER (tier = 'hot') AS hot_keys, CAST(coalesce(sum(size) FILTER (tier = 'hot'), 0) AS BIGINT) AS hot_bytes, count(*) FILTER (tier = 'warm') AS warm_keys, CAST(coalesce(sum(size) FILTER (tier = 'warm'), 0) AS BIGINT) AS warm_bytes,
count(*) FILTER (tier = 'cold') AS cold_keys, CAST(coalesce(sum(size) FILTER (tier = 'cold'), 0) AS BIGINT) AS cold_bytes, count(*) AS keys, count(*) FILTER (move = 'promote') AS up, count(*) FILTER (move = 'demote') AS down FROM moves"""
)
def tier_report(spark: SparkSession, d: str) -> DataFrame:
    stats = _stats(spark, d)
    return tiering.tier_report(stats, tiering.default_policy(stats, V.NOW_US))


# ---- frequencies


@query(f"WITH {LOG} SELECT key, least(count(*), 15) AS frequency FROM log GROUP BY key")
def cms_frequency(spark: SparkSession, d: str) -> DataFrame:
    return sketches.capped_frequency(V.log(spark, d), 15)


@query(f"WITH {LOG} SELECT key, count(*) - 1 AS counted FROM log GROUP BY key HAVING count(*) > 1")
def cms_doorkeeper(spark: SparkSession, d: str) -> DataFrame:
    return sketches.doorkeeper(V.log(spark, d))


@query(
    f"""WITH {LOG}, f AS (SELECT key, least(count(*), 15) AS f FROM log GROUP BY key), p AS (SELECT 'user:' || c_custkey AS candidate, 'user:' || (c_custkey + 1) AS victim FROM customer)
SELECT candidate, victim, coalesce(c.f, 0) > coalesce(v.f, 0) AS admitted FROM p LEFT JOIN f c ON candidate = c.key LEFT JOIN f v ON victim = v.key"""
)
def cms_admit(spark: SparkSession, d: str) -> DataFrame:
    name = lambda n: F.concat(F.lit("user:"), n.cast("string"))
    pairs = V.customer_keys(spark, d).select(name(F.col("c_custkey")).alias("candidate"), name(F.col("c_custkey") + 1).alias("victim"))
    return sketches.admit(cms_frequency(spark, d), pairs, strict=True)


@query()
def cms_sketch_size(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's bytes; its estimates are tested against exact counts."""
    return sketches.count_min(V.log(spark, d)).select(F.octet_length("sketch").alias("bytes"))


@query(f"WITH {LOG} SELECT key, true AS within FROM log GROUP BY key")
def cms_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Whether each key's estimate is no less than its uses, and no more than the sketch's error above them."""
    log = V.log(spark, d)
    table = sketches.count_min_table(log, 2048, 4)
    estimates = sketches.estimated(table, log.select("key").distinct(), 2048, 4)
    uses = log.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    bound = F.col("uses") + F.lit(8 / 2048 * log.count())
    return uses.join(estimates, "key").select("key", ((F.col("estimate") >= F.col("uses")) & (F.col("estimate") <= bound)).alias("within"))


@query(f"WITH {LOG} SELECT count(DISTINCT key) AS exact, true AS near FROM log")
def distinct_approx(spark: SparkSession, d: str) -> DataFrame:
    """The exact count, and whether the sketch is within five of its standard errors."""
    return sketches.distinct_keys(V.log(spark, d)).select("exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.1 * F.col("exact") + 1).alias("near"))


@query(f"WITH {LOG} SELECT key, least(count(*), 255) AS frequency FROM log GROUP BY key")
def cms_frequency_tiered(spark: SparkSession, d: str) -> DataFrame:
    return sketches.capped_frequency(V.log(spark, d), 255)


@query(
    f"""WITH RECURSIVE {LOG}, b AS (SELECT key, CAST(9 - least(floor(({NOW} - us) / {DAY}), 9) AS INTEGER) AS b, count(*) AS n FROM log WHERE {NOW} - us >= 0 GROUP BY 1, 2),
k AS (SELECT DISTINCT key FROM b), f(key, b, uses) AS (SELECT key, -1, 0::BIGINT FROM k UNION ALL SELECT f.key, f.b + 1, (f.uses + coalesce(b.n, 0)) // 2 FROM f LEFT JOIN b ON f.key = b.key AND b.b = f.b + 1 WHERE f.b < 9)
SELECT key, uses FROM f WHERE b = 9"""
)
def tier_decay(spark: SparkSession, d: str) -> DataFrame:
    """Ten days are told apart; what is older counts in the first of them."""
    return sketches.decayed(V.log(spark, d), DAY, 10, V.NOW_US, older=True)


@query(f"{STATS} SELECT CASE WHEN grouping(tier) = 1 THEN 'all' ELSE tier END AS tier, CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type, count(*) AS keys, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT *, CASE WHEN uses % 2 = 0 THEN 'string' ELSE 'hash' END AS type FROM stats) GROUP BY ROLLUP (tier, type)")
def tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tiering.rollup(_stats(spark, d).withColumn("type", F.when(F.col("uses") % 2 == 0, "string").otherwise("hash")))


@query(f"{STATS} SELECT key, CASE WHEN tier <> 'hot' AND f >= 10 THEN 'promote' WHEN (tier = 'hot' AND idle > 300 AND (f <= 2 OR f < 10)) OR (tier = 'warm' AND {UTILITY} <= -0.5) THEN 'demote' ELSE 'stay' END AS move FROM (SELECT *, CASE WHEN uses % 3 = 0 THEN uses // 2 ELSE least(uses, 255) END AS f FROM stats)")
def tier_policy_estimates(spark: SparkSession, d: str) -> DataFrame:
    """A sketch knows one key in three, and tells half of its uses."""
    stats = _stats(spark, d)
    known = stats.where("uses % 3 = 0").select("key", F.floor(F.col("uses") / 2).alias("estimate"))
    return tiering.cost_policy(stats, V.NOW_US, estimates=known).select("key", "move")


@query(
    f"""{STATS}, c AS (SELECT key, tier, last_us, size FROM stats WHERE NOT (tier <> 'hot' AND least(uses, 255) >= 70) AND ((tier = 'hot' AND idle > 300 AND (least(uses, 255) <= 14 OR least(uses, 255) < 70)) OR (tier = 'warm' AND {UTILITY} <= -0.5))),
p AS (SELECT key, tier, row_number() OVER w AS n, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM c WINDOW w AS (PARTITION BY tier ORDER BY last_us, key)) SELECT key, tier, n, CAST(total AS BIGINT) AS total_bytes FROM p WHERE n <= 100"""
)
def tier_migration_plan_cost(spark: SparkSession, d: str) -> DataFrame:
    return tiering.migration_plan(_stats(spark, d), V.NOW_US, 100, policy=lambda stats, now: tiering.cost_policy(stats, now, protected=70))


@query(f"{TIERS}, k AS (SELECT key FROM w WHERE u % 2 = 0 UNION ALL SELECT key FROM w WHERE u % 3 = 0), g AS (SELECT key, count(*) AS n FROM k WHERE key IN (SELECT 'user:' || c_custkey FROM customer) GROUP BY key) SELECT count(*) AS deleted, CAST(coalesce(sum(n), 0) AS BIGINT) AS summed FROM g")
def tier_del(spark: SparkSession, d: str) -> DataFrame:
    """Of two tiers that share a third of the smaller one's keys."""
    users = V.log(spark, d).groupBy("key").agg(F.max("user_id").alias("u"))
    tiers = [users.where("u % 2 = 0").select("key"), users.where("u % 3 = 0").select("key")]
    wanted = V.customer_keys(spark, d).select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return tiering.delete(tiers, wanted)[1]


@query(
    f"""{STATS} SELECT key, CASE WHEN uses % 4 = 0 OR move = 'stay' THEN tier WHEN move = 'promote' THEN 'hot' WHEN tier = 'hot' THEN 'warm' ELSE 'cold' END AS tier, 'string' AS type, CASE WHEN uses % 4 = 0 THEN {NOW} - 1 ELSE {NOW} + uses END AS expire_at_us FROM moves"""
)
def tier_demote_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows move with type and expiry; one key in four or so has expired and stays."""
    stats = _stats(spark, d)
    entries = stats.select("key", "tier", F.lit("string").alias("type"), F.when(F.col("uses") % 4 == 0, F.lit(V.NOW_US - 1)).otherwise(F.lit(V.NOW_US) + F.col("uses")).alias("expire_at_us"))
    return tiering.demote_rows(entries, tiering.default_policy(stats, V.NOW_US), V.NOW_US).select("key", "tier", "type", "expire_at_us")


# ---- hot slots

TRAFFIC = f"{SLOTTED}, t AS (SELECT slot % 64 AS slot, us // {DAY} - 19723 AS tick, count(*) AS requests, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM s GROUP BY 1, 2)"


def _traffic(spark: SparkSession, d: str) -> DataFrame:
    """Requests of 64 groups of slots by day; 2024-01-01 is day 0."""
    rows = V.log(spark, d)
    slots = cluster.with_slot(rows.select("key").distinct())
    day = F.floor(F.col("us") / DAY) - 19723
    return rows.join(slots, "key").groupBy((F.col("slot") % 64).alias("slot"), day.alias("tick")).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.octet_length("props")).alias("bytes"))


HOT = f"{TRAFFIC}, m AS (SELECT *, avg(requests) OVER (PARTITION BY tick) AS mean FROM t), h AS (SELECT tick, slot, requests, bytes, requests / mean AS score, row_number() OVER (PARTITION BY tick ORDER BY requests / mean DESC, slot) AS n FROM m WHERE mean >= 1 AND requests > 1.5 * mean AND tick >= 10 QUALIFY n <= 20)"


def _hot(spark: SparkSession, d: str) -> DataFrame:
    return cluster.hot_slots(_traffic(spark, d), factor=1.5, least=1.0)


@query(f"{HOT} SELECT tick, slot, requests, bytes, round(score, 9) AS score, n FROM h")
def hot_slots(spark: SparkSession, d: str) -> DataFrame:
    return _hot(spark, d).withColumn("score", F.round("score", 9))


@query(f"{HOT}, i AS (SELECT *, tick - row_number() OVER (PARTITION BY slot ORDER BY tick) AS island FROM h WHERE score >= 1.5 AND slot <> 0) SELECT slot, min(tick) AS first, max(tick) AS last, count(*) AS ticks, round(max(score), 9) AS score FROM i GROUP BY slot, island HAVING count(*) >= 2")
def hot_sticky(spark: SparkSession, d: str) -> DataFrame:
    return cluster.sticky(_hot(spark, d), run=2, score=1.5).withColumn("score", F.round("score", 9))


@query(
    f"""{TRAFFIC.replace('WITH', 'WITH RECURSIVE', 1)}, k AS (SELECT DISTINCT slot FROM t), f(slot, tick, base) AS (SELECT slot, -1, 0.0::DOUBLE FROM k
UNION ALL SELECT f.slot, f.tick + 1, f.base * 0.9 + 0.1 * coalesce(t.requests, 0) FROM f LEFT JOIN t ON t.slot = f.slot AND t.tick = f.tick + 1 WHERE f.tick < 29) SELECT slot, round(base, 6) AS baseline FROM f WHERE tick = 29"""
)
def hot_baseline(spark: SparkSession, d: str) -> DataFrame:
    return cluster.baseline(_traffic(spark, d), 30).withColumn("baseline", F.round("baseline", 6))


@query(
    f"""{TRAFFIC.replace('WITH', 'WITH RECURSIVE', 1)}, c(slot, tick) AS (SELECT slot, min(tick) FROM t WHERE requests >= 3 GROUP BY slot UNION ALL SELECT c.slot, (SELECT min(tick) FROM t WHERE t.slot = c.slot AND requests >= 3 AND t.tick > c.tick + 5) FROM c
WHERE EXISTS (SELECT 1 FROM t WHERE t.slot = c.slot AND requests >= 3 AND t.tick > c.tick + 5)) SELECT slot, CAST(tick AS INTEGER) AS tick FROM c"""
)
def hot_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a slot has three requests, with five days of rest after each that counts."""
    return cluster.cooled(_traffic(spark, d).where("requests >= 3").select("slot", "tick"), 64, 5)


@query(f"{CUST} SELECT key, slot, CASE WHEN slot < 5000 THEN 'node-0' WHEN slot < 11000 THEN 'node-1' ELSE 'node-2' END AS owner FROM k")
def slot_owner_ranges(spark: SparkSession, d: str) -> DataFrame:
    ranges = spark.createDataFrame([(0, 4999, "node-0"), (5000, 10999, "node-1"), (11000, 16383, "node-2")], "first int, last int, owner string")
    return cluster.owners_by_range(cluster.with_slot(V.customer_keys(spark, d).select("key")), ranges)


@query(f"{CUST} SELECT key, slot, CASE WHEN slot % 10 = 0 THEN 'node-9' ELSE 'node-' || slot % 3 END AS node FROM k")
def slot_drain(spark: SparkSession, d: str) -> DataFrame:
    """One slot in ten moves as a whole."""
    entries = cluster.with_slot(V.customer_keys(spark, d).select("key")).withColumn("node", F.concat(F.lit("node-"), (F.col("slot") % 3).cast("string")))
    moves = spark.range(16384).where("id % 10 = 0").select(F.col("id").cast("int").alias("slot"), F.lit("node-9").alias("target"))
    return cluster.drain_slots(entries, moves)


@query(
    f"""{TRAFFIC}, q AS (SELECT slot, CAST(sum(requests) AS DOUBLE) AS qps FROM t GROUP BY slot), l0 AS (SELECT 'node-' || CASE WHEN slot < 40 THEN 0 ELSE (slot - 40) % 3 + 1 END AS node, sum(qps) AS load FROM q GROUP BY 1),
a AS (SELECT slot, qps, row_number() OVER (ORDER BY qps DESC, slot) AS n FROM q WHERE slot < 40 QUALIFY n <= 2), t1 AS (SELECT node, load FROM l0 WHERE node <> 'node-0' ORDER BY load, node LIMIT 1),
m1 AS (SELECT slot, qps, t1.node AS target FROM a, t1, l0 WHERE a.n = 1 AND l0.node = 'node-0' AND t1.load + qps <= l0.load - qps),
l1 AS (SELECT node, load + coalesce((SELECT sum(CASE WHEN target = node THEN qps WHEN node = 'node-0' THEN -qps ELSE 0 END) FROM m1), 0) AS load FROM l0),
t2 AS (SELECT node, load FROM l1 WHERE node <> 'node-0' ORDER BY load, node LIMIT 1), m2 AS (SELECT slot, qps, t2.node AS target FROM a, t2, l1 WHERE a.n = 2 AND l1.node = 'node-0' AND t2.load + qps <= l1.load - qps)
SELECT slot, 'node-0' AS source, target, qps FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2)"""
)
def rebalance_plan(spark: SparkSession, d: str) -> DataFrame:
    """The two hottest groups of slots leave the busiest of four nodes; tests plan the same by hand."""
    traffic = _traffic(spark, d)
    total = traffic.groupBy("slot").agg(F.sum("requests").cast("double").alias("qps"))
    owner = F.concat(F.lit("node-"), F.when(F.col("slot") < 40, 0).otherwise((F.col("slot") - 40) % 3 + 1).cast("string"))
    loads = total.groupBy(owner.alias("node")).agg(F.sum("qps").alias("qps"))
    return cluster.greedy_plan(total.where("slot < 40").select("slot", "qps", F.col("qps").alias("score")), loads, "node-0")
