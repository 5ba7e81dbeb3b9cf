"""Queries over service metrics, pastes, entries as text, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.operators import cluster, observability, pastes, strings
from kvloom.plans.registry import LOG, NOW, query
from kvloom.sources import codec
from kvloom.sources import views as V
from kvloom.streaming import keyspace

HOUR = 3_600_000_000
CALLS = f"WITH {LOG}, c AS (SELECT op AS cmd, CASE WHEN op = 'error' THEN 'error' ELSE 'ok' END AS status, score / 1000 AS seconds, us, seq, key, delta % 2 = 0 AS hit FROM log)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("op") == "error", "error").otherwise("ok")
    return V.log(spark, d).select(F.col("op").alias("cmd"), status.alias("status"), (F.col("score") / 1000).alias("seconds"), "us", "seq", "key", (F.col("delta") % 2 == 0).alias("hit"))


@query(f"{CALLS} SELECT CASE WHEN cmd IN ('click', 'view', 'error') THEN cmd ELSE 'other' END AS cmd, status, count(*) AS n FROM c GROUP BY 1, 2")
def obs_command_counts(spark: SparkSession, d: str) -> DataFrame:
    return observability.command_counts(_calls(spark, d), ["click", "view", "error"])


@query(
    f"""{CALLS}, b AS (SELECT * FROM (VALUES (0.0001, '0.0001'), (0.0005, '0.0005'), (0.001, '0.001'), (0.005, '0.005'), (0.01, '0.01'), (0.05, '0.05'), (0.1, '0.1'), (0.5, '0.5'), (1.0, '1.0'), (1e300, '+Inf')) t(bound, le))
SELECT cmd, le, count(*) FILTER (seconds <= bound) AS n FROM c, b GROUP BY cmd, le"""
)
def obs_latency_buckets(spark: SparkSession, d: str) -> DataFrame:
    return observability.latency_histogram(_calls(spark, d))


@query(f"{CALLS}, w AS (SELECT us // {HOUR} AS win, count(*) FILTER (status = 'error') AS errors, count(*) AS total FROM c GROUP BY 1) SELECT win, errors, total, (errors / 3600.0) / greatest(total / 3600.0, 1.0) AS ratio, (errors / 3600.0) / greatest(total / 3600.0, 1.0) > 0.0005 AS alert FROM w")
def obs_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return observability.error_rate(_calls(spark, d), HOUR, 0.0005)


@query(
    f"""{CALLS}, w AS (SELECT (us // {HOUR // 4} - k) * {HOUR // 4} AS start, count(*) FILTER (status = 'error') AS errors, count(*) AS total FROM c, (VALUES (0), (1), (2), (3)) t(k) GROUP BY 1)
SELECT start, errors, total, (errors / 3600.0) / greatest(total / 3600.0, 1.0) AS ratio, (errors / 3600.0) / greatest(total / 3600.0, 1.0) > 0.0005 AS alert FROM w"""
)
def obs_error_rate_sliding(spark: SparkSession, d: str) -> DataFrame:
    return observability.error_rate_sliding(_calls(spark, d), HOUR, HOUR // 4, 0.0005)


@query(f"{CALLS} SELECT cmd, round(quantile_cont(seconds, 0.99), 9) AS value, quantile_cont(seconds, 0.99) > 0.1 AS alert FROM c GROUP BY cmd")
def obs_p99(spark: SparkSession, d: str) -> DataFrame:
    return observability.quantile(_calls(spark, d)).withColumn("value", F.round("value", 9))


@query(f"{CALLS}, s AS (SELECT DISTINCT cmd AS name, h.win, (SELECT count(*) FROM c x WHERE x.cmd = c.cmd AND x.us // {24 * HOUR} <= h.win AND x.hit) AS total FROM c, (SELECT DISTINCT us // {24 * HOUR} AS win FROM c) h) SELECT name, win, total FROM (SELECT *, total - lag(total) OVER (PARTITION BY name ORDER BY win) AS grown FROM s) WHERE grown = 0")
def obs_idle_counter(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    calls = _calls(spark, d)
    days = calls.select(F.floor(F.col("us") / (24 * HOUR)).alias("win")).distinct()
    grid = calls.select(F.col("cmd").alias("name")).distinct().crossJoin(F.broadcast(days))  # names x days
    hits = calls.where("hit").groupBy(F.col("cmd").alias("name"), F.floor(F.col("us") / (24 * HOUR)).alias("win")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("name").orderBy("win"))
    return observability.idle_counter(grid.join(hits, ["name", "win"], "left").select("name", "win", total.alias("total")))


@query(f"{CALLS} SELECT us // {HOUR} AS win, count(*) AS ops, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT key) AS keys FROM c GROUP BY 1")
def obs_overview(spark: SparkSession, d: str) -> DataFrame:
    return observability.overview(_calls(spark, d), HOUR)


@query("SELECT 'doc:' || doc_id AS key, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN strlen(text) <= 20000 THEN substr(text, 1, 40) END AS value, strlen(text) > 40 AS truncated FROM documents")
def obs_key_detail(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    return observability.key_detail(docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("value")), 40, 20000)


@query(f"WITH {LOG} SELECT us, seq, key, op FROM log ORDER BY us DESC, seq DESC LIMIT 100")
def obs_audit(spark: SparkSession, d: str) -> DataFrame:
    return observability.audit(V.log(spark, d), 100)


# ---- pastes: documents, read by the turns of conversations

PASTES = f"""WITH p AS (SELECT 'p' || doc_id AS code, text AS content, CASE doc_id % 7 WHEN 0 THEN '5m' WHEN 1 THEN '30m' WHEN 2 THEN '1h' WHEN 3 THEN '6h' WHEN 4 THEN '1d' WHEN 5 THEN '7d' ELSE '2d' END AS ttl,
  CASE doc_id % 7 WHEN 0 THEN 300 WHEN 1 THEN 1800 WHEN 2 THEN 3600 WHEN 3 THEN 21600 WHEN 4 THEN 86400 WHEN 5 THEN 604800 END AS ttl_s, doc_id % 4 AS max_views, doc_id % 5 = 0 AS burn, {NOW} - doc_id % 1000 * 1000000 AS created_us FROM documents),
r AS (SELECT 'p' || conv_id % 200 AS code, {NOW} + conv_id * 60000000 + turn AS us, conv_id * 1000 + turn AS seq FROM conversations)"""


def _pastes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    names = F.array(*[F.lit(x) for x in (*pastes.PRESETS, "2d")])
    ttl = F.get(names, (i % 7).cast("int"))
    return V.table(spark, d, "documents").select(
        F.concat(F.lit("p"), i.cast("string")).alias("code"), F.col("text").alias("content"), ttl.alias("ttl"), pastes.preset_seconds(ttl).alias("ttl_s"), (i % 4).alias("max_views"), (i % 5 == 0).alias("burn"), (F.lit(V.NOW_US) - i % 1000 * 1_000_000).alias("created_us")
    )


def _reads(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "conversations")
    return c.select(F.concat(F.lit("p"), (F.col("conv_id") % 200).cast("string")).alias("code"), (F.lit(V.NOW_US) + F.col("conv_id") * 60_000_000 + F.col("turn")).alias("us"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))


@query(f"{PASTES} SELECT code, CASE WHEN coalesce(strlen(content), 0) = 0 THEN 'empty' WHEN strlen(content) > 65536 THEN 'too large' WHEN ttl_s IS NULL THEN 'bad ttl' WHEN max_views < 0 THEN 'bad views' WHEN burn AND max_views > 0 THEN 'exclusive' ELSE 'ok' END AS result FROM p")
def paste_validate(spark: SparkSession, d: str) -> DataFrame:
    return pastes.validate(_pastes(spark, d))


SERVED = f"""{PASTES}, n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY us, seq) AS n FROM r),
served AS (SELECT seq, n.code, coalesce(us BETWEEN created_us AND created_us + ttl_s * 1000000::BIGINT, false) AND CASE WHEN burn THEN n <= 1 WHEN max_views > 0 THEN n <= max_views ELSE true END AS served FROM n LEFT JOIN p ON n.code = p.code)"""


@query(f"{SERVED} SELECT seq, code, served FROM served")
def paste_read_limit(spark: SparkSession, d: str) -> DataFrame:
    return pastes.read(_pastes(spark, d), _reads(spark, d))


@query(f"{PASTES}, v AS (SELECT code, count(*) AS views FROM r GROUP BY code) SELECT p.code, created_us, coalesce(views, 0) AS views FROM p LEFT JOIN v ON p.code = v.code WHERE max_views = 0 OR coalesce(views, 0) < max_views")
def paste_admin_list(spark: SparkSession, d: str) -> DataFrame:
    return pastes.admin_list(_pastes(spark, d), _reads(spark, d))


@query(f"{SERVED} SELECT * FROM (SELECT count(*) AS created, count(*) FILTER (created_us + ttl_s * 1000000::BIGINT < {NOW}) AS expired FROM p), (SELECT count(*) FILTER (served) AS read, count(*) FILTER (served AND burn) AS burned, count(*) FILTER (NOT served) AS refused FROM served JOIN p ON served.code = p.code)")
def paste_usage(spark: SparkSession, d: str) -> DataFrame:
    return pastes.usage(_pastes(spark, d), paste_read_limit(spark, d), V.NOW_US)


@query(
    f"""WITH RECURSIVE {LOG}, f(key, begin) AS (SELECT key, min(us) FROM log GROUP BY key UNION ALL SELECT f.key, (SELECT min(us) FROM log x WHERE x.key = f.key AND x.us >= f.begin + {24 * HOUR}) FROM f WHERE EXISTS (SELECT 1 FROM log x WHERE x.key = f.key AND x.us >= f.begin + {24 * HOUR}))
SELECT log.key AS client, seq, row_number() OVER (PARTITION BY log.key, begin ORDER BY us, seq) <= 2 AS passed FROM log JOIN f ON log.key = f.key AND us >= begin AND us < begin + {24 * HOUR}"""
)
def rate_limit_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Two commands of a user in a day that begins with its first; tests fold the same in plain Python."""
    return pastes.rate_limit(V.log(spark, d).select(F.col("key").alias("client"), "us", "seq"), 2, 24 * HOUR)


# ---- entries as text


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """An entry of each type for each customer, as a whole."""
    c = V.customer_keys(spark, d)
    number = F.col("c_custkey").cast("string")
    kind = F.get(F.array(*[F.lit(t) for t in codec.TYPES]), (F.col("c_custkey") % 5).cast("int"))
    only = lambda t, v: F.when(F.col("type") == t, v)
    rows = c.withColumn("type", kind)
    return rows.select(
        "key",
        "type",
        only("string", F.concat(F.lit('a"b\\é:'), number)).alias("str"),
        only("list", F.array(number, F.lit(""), number)).alias("list"),
        only("set", F.array(F.lit("x"), number)).alias("members"),
        only("hash", F.create_map(F.lit("seg"), F.col("c_mktsegment"))).alias("hash"),
        only("zset", F.create_map(number, F.col("c_custkey") / 8)).alias("scores"),
    )


@query("SELECT 'cust:' || c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'list' WHEN 2 THEN 'set' WHEN 3 THEN 'zset' ELSE 'hash' END AS type, true AS same FROM customer")
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    back = codec.restore(codec.dump(entries))
    text = lambda df, name: df.select("key", "type", F.to_json(F.struct("str", "list", "members", "hash", "scores")).alias(name))
    return text(back, "b").join(text(entries, "a").drop("type"), "key").select("key", "type", (F.col("a") == F.col("b")).alias("same"))


# ---- streams; each is drained into a table and read back


@query(f"WITH {LOG} SELECT key, arg_max(op, (us, seq)) AS value, count(*) AS writes FROM log GROUP BY key")
def stream_keyspace(spark: SparkSession, d: str) -> DataFrame:
    return keyspace.drain_keyspace(spark, d)


@query(f"WITH {LOG} SELECT us // {24 * HOUR} AS win, op, count(*) AS n FROM log GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return keyspace.drain_windows(spark, d)


@query(f"WITH {LOG} SELECT key, op, seq FROM log")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return keyspace.drain_deduped(spark, d)


@query(
    f"""WITH {LOG}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY key ORDER BY us) < {2 * 24 * HOUR} THEN 0 ELSE 1 END AS fresh FROM log),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS life FROM g)
SELECT key, max(us) + {2 * 24 * HOUR} AS expire_us, arg_max(op, (us, seq)) AS value, count(*) AS writes FROM s GROUP BY key, life HAVING max(us) + {2 * 24 * HOUR} <= (SELECT max(us) // 1000 * 1000 FROM log) - {HOUR}"""
)
def stream_expired(spark: SparkSession, d: str) -> DataFrame:
    """Keys with a time to live of two days after their last write, told as they expire."""
    return keyspace.drain_expired(spark, d)


# ---- sources and sinks: written beside the checkpoints and read back


@query("SELECT 'cust:' || c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'list' WHEN 2 THEN 'set' WHEN 3 THEN 'zset' ELSE 'hash' END AS type FROM customer")
def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = keyspace.shared_folder(spark)
    codec.save(cluster.with_slot(_entries(spark, d)), path)
    return codec.load(spark, path).select("key", "type")


@query(f"WITH {LOG}, k AS (SELECT key, arg_max(op, (us, seq)) AS value, CASE max(seq) % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier FROM log GROUP BY key) SELECT key, value, tier FROM k WHERE tier <> 'cold'")
def tier_folders(spark: SparkSession, d: str) -> DataFrame:
    """A folder a tier, of which two are read."""
    path = keyspace.shared_folder(spark)
    tier = F.get(F.array(F.lit("hot"), F.lit("warm"), F.lit("cold")), (F.max("seq") % 3).cast("int"))
    rows = V.str_rows(spark, d).groupBy("key").agg(F.max_by("value", V.place()).alias("value"), tier.alias("tier"))
    codec.save_tiers(rows, path)
    return codec.load(spark, path).where(F.col("tier").isin("hot", "warm")).select("key", "value", "tier")


@query(f"WITH {LOG} SELECT key, arg_max(op, (us, seq)) AS value FROM log GROUP BY key")
def commands_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The log as JSON lines, and the keyspace of what is read from them."""
    path = keyspace.shared_folder(spark)
    V.log(spark, d).select("key", F.lit("SET").alias("op"), F.array("op").alias("args"), "us", "seq").write.json(path)
    read = codec.read_commands(spark, path)
    return strings.last_write(read.select("key", F.get("args", F.lit(0)).alias("value"), "us", "seq"))


@query("SELECT CAST(s AS INTEGER) AS slot, 'node-' || s % 3 AS owner, CAST(s % 7 AS BIGINT) AS epoch, CASE s % 2 WHEN 0 THEN 'stable' ELSE 'importing' END AS state FROM range(256) t(s)")
def cluster_state_file(spark: SparkSession, d: str) -> DataFrame:
    """A cluster's state written as its JSON file, and read."""
    path = keyspace.shared_folder(spark)
    s = F.col("id")
    slots = spark.range(256).select(s.cast("int").alias("slot"), F.concat(F.lit("node-"), (s % 3).cast("string")).alias("owner"), (s % 7).alias("epoch"), F.when(s % 2 == 0, "stable").otherwise("importing").alias("state"))
    codec.save_cluster_state(slots, path)
    return codec.cluster_state(spark, path)


@query(f"WITH {LOG} SELECT key, count(*) AS writes, arg_max(op, (us, seq)) AS value FROM log WHERE op <> 'error' GROUP BY key")
def sql_over_keyspace(spark: SparkSession, d: str) -> DataFrame:
    """SQL text over the log, registered as a view of a session of its own."""
    session = V.register(spark, d)
    return session.sql("SELECT key, count(*) AS writes, max_by(op, struct(us, seq)) AS value FROM kv_log WHERE op <> 'error' GROUP BY key")
