"""Queries over strings, hashes, lists, sets, sorted sets and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions.numbers import plain_double
from kvloom.operators import expiry, hashes, keys, lists, sets, strings, zsets
from kvloom.plans.registry import LOG, NOW, TTL, query
from kvloom.sources import views as V

# ---- strings and counters


@query(f"WITH {LOG} SELECT key, arg_max(op, (us, seq)) AS value FROM log GROUP BY key")
def str_last_write(spark: SparkSession, d: str) -> DataFrame:
    return strings.last_write(V.str_rows(spark, d))


@query(f"WITH {LOG} SELECT key, arg_min(op, (us, seq)) AS value FROM log GROUP BY key")
def str_setnx(spark: SparkSession, d: str) -> DataFrame:
    return strings.first_write(V.str_rows(spark, d))


def _customer_writes(spark: SparkSession, d: str) -> DataFrame:
    c = V.customer_keys(spark, d)
    return c.select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("us"), F.col("c_custkey").alias("seq"))


@query(f"WITH {LOG} SELECT 'user:' || c_custkey AS key, c_mktsegment AS value FROM customer WHERE 'user:' || c_custkey NOT IN (SELECT key FROM log)")
def str_setnx_existing(spark: SparkSession, d: str) -> DataFrame:
    return strings.set_nx(strings.last_write(V.str_rows(spark, d)), _customer_writes(spark, d))


@query(f"WITH {LOG} SELECT 'user:' || c_custkey AS key, c_mktsegment AS value FROM customer WHERE 'user:' || c_custkey IN (SELECT key FROM log)")
def str_setxx(spark: SparkSession, d: str) -> DataFrame:
    return strings.set_xx(strings.last_write(V.str_rows(spark, d)), _customer_writes(spark, d))


@query(f"WITH {LOG} SELECT key, arg_max(op, (us, seq)) AS value, arg_max(us, (us, seq)) + {TTL} AS expire_at_us FROM log GROUP BY key")
def str_setex(spark: SparkSession, d: str) -> DataFrame:
    return strings.set_ex(V.str_rows(spark, d), V.TTL_US)


@query(f"WITH {LOG} SELECT seq, key, nullif(lag(op) OVER (PARTITION BY key ORDER BY us, seq), '') AS old FROM log")
def str_getset(spark: SparkSession, d: str) -> DataFrame:
    return strings.getset(V.str_rows(spark, d))


@query(
    f"""WITH {LOG}, k AS (SELECT key, arg_max(op, (us, seq)) AS value FROM log GROUP BY key),
r AS (SELECT c_custkey * 2 + n AS pos, 'user:' || c_custkey AS key FROM customer, (VALUES (0), (1)) t(n))
SELECT pos, r.key, value FROM r LEFT JOIN k ON r.key = k.key"""
)
def str_mget(spark: SparkSession, d: str) -> DataFrame:
    writes = _customer_writes(spark, d)
    request = writes.select("seq", "key", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select((F.col("seq") * 2 + F.col("n")).alias("pos"), "key")
    return strings.mget(strings.last_write(V.str_rows(spark, d)), request)


@query(
    f"""WITH {LOG}, k AS (SELECT key, 'string' AS type, arg_max(op, (us, seq)) AS value FROM log GROUP BY key UNION ALL SELECT DISTINCT 'list:' || user_id, 'list', NULL FROM log),
r AS (SELECT prefix || c_custkey AS key FROM customer, (VALUES ('user:'), ('list:'), ('none:')) t(prefix))
SELECT r.key, value, coalesce(CASE WHEN type <> 'string' THEN 'WRONGTYPE' END, '') AS error FROM r LEFT JOIN k ON r.key = k.key"""
)
def str_get(spark: SparkSession, d: str) -> DataFrame:
    values = strings.last_write(V.str_rows(spark, d)).select("key", F.lit("string").alias("type"), "value")
    others = V.typed_keys(spark, d).where("type = 'list'").select("key", "type", F.lit(None).cast("string").alias("value"))
    prefixes = F.explode(F.array(F.lit("user:"), F.lit("list:"), F.lit("none:")))
    probes = V.customer_keys(spark, d).select(prefixes.alias("p"), "c_custkey").select(F.concat("p", F.col("c_custkey").cast("string")).alias("key"))
    return strings.get(values.unionByName(others), probes).withColumn("error", F.coalesce("error", F.lit("")))


@query(
    f"""WITH {LOG}, r AS (SELECT c_custkey AS request, 'user:' || c_custkey AS key, {NOW} - c_custkey % 30 * 86400000000 AS us FROM customer)
SELECT request, arg_max(op, (log.us, seq)) AS value FROM r LEFT JOIN log ON r.key = log.key AND log.us <= r.us GROUP BY request"""
)
def str_get_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What each key was at a time of the past."""
    at = F.lit(V.NOW_US) - F.col("seq") % 30 * 86_400_000_000
    return strings.get_as_of(V.str_rows(spark, d), _customer_writes(spark, d).select(F.col("seq").alias("request"), "key", at.alias("us")))


@query("SELECT 'cust:' || o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1")
def str_mset(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    return strings.last_write(o.select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("value"), F.lit(0).alias("us"), F.col("o_orderkey").alias("seq")))


@query(f"WITH {LOG} SELECT key, md5(string_agg(op, '' ORDER BY us, seq)) AS digest, CAST(strlen(string_agg(op, '' ORDER BY us, seq)) AS BIGINT) AS bytes FROM log GROUP BY key")
def str_append_strlen(spark: SparkSession, d: str) -> DataFrame:
    values = strings.append(V.str_rows(spark, d))
    return values.select("key", F.md5(F.col("value").cast("binary")).alias("digest")).join(strings.strlen(values), "key")


@query(f"WITH {LOG} SELECT key, CAST(sum(delta) AS BIGINT) AS total FROM log GROUP BY key")
def ctr_incrby(spark: SparkSession, d: str) -> DataFrame:
    return strings.incr_total(V.log(spark, d))


@query(f"WITH {LOG} SELECT key, CAST(-sum(delta) AS BIGINT) AS total FROM log GROUP BY key")
def ctr_decrby(spark: SparkSession, d: str) -> DataFrame:
    return strings.incr_total(V.log(spark, d), -1)


@query(f"WITH {LOG} SELECT seq, key, CAST(sum(delta) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM log")
def ctr_incr_trace(spark: SparkSession, d: str) -> DataFrame:
    return strings.incr_trace(V.log(spark, d))


# ---- hashes

HASH = f"WITH {LOG}, h AS (SELECT key, op AS field, arg_max(txt, (us, seq)) AS value FROM log GROUP BY key, op)"


@query(f"{HASH} SELECT key, field, value FROM h")
def hash_hset(spark: SparkSession, d: str) -> DataFrame:
    return hashes.hset(V.hash_rows(spark, d))


def _half(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The hashes of even rows, and the odd rows."""
    rows = V.hash_rows(spark, d)
    return hashes.hset(rows.where("seq % 2 = 0")), rows.where("seq % 2 = 1")


@query(f"WITH {LOG} SELECT key, count(*) AS added FROM (SELECT DISTINCT key, op FROM log WHERE seq % 2 = 1 EXCEPT SELECT key, op FROM log WHERE seq % 2 = 0) GROUP BY key")
def hash_hset_added(spark: SparkSession, d: str) -> DataFrame:
    return hashes.hset_added(*_half(spark, d))


def _field_probes(spark: SparkSession, d: str) -> DataFrame:
    return _customer_writes(spark, d).select("key", F.explode(F.array(F.lit("click"), F.lit("none"))).alias("field"))


PROBES = "p AS (SELECT 'user:' || c_custkey AS key, field FROM customer, (VALUES ('click'), ('none')) t(field))"


@query(f"{HASH}, {PROBES} SELECT p.key, p.field, value FROM p LEFT JOIN h ON p.key = h.key AND p.field = h.field")
def hash_hget(spark: SparkSession, d: str) -> DataFrame:
    return hashes.hget(hash_hset(spark, d), _field_probes(spark, d))


@query(f"{HASH}, {PROBES} SELECT p.key, p.field, CAST(value IS NOT NULL AS BIGINT) AS found FROM p LEFT JOIN h ON p.key = h.key AND p.field = h.field")
def hash_hexists(spark: SparkSession, d: str) -> DataFrame:
    return hashes.hexists(hash_hset(spark, d), _field_probes(spark, d))


@query(f"{HASH} SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS pairs, string_agg(field, ',' ORDER BY field) AS fields, string_agg(value, ',' ORDER BY field) AS vals FROM h GROUP BY key")
def hash_hgetall(spark: SparkSession, d: str) -> DataFrame:
    return hashes.hgetall(hash_hset(spark, d))


@query(f"{HASH} SELECT key, field, value, row_number() OVER (PARTITION BY key ORDER BY field) - 1 AS i FROM h")
def hash_nested(spark: SparkSession, d: str) -> DataFrame:
    """The nested form, taken apart again."""
    pairs = hashes.nested(hash_hset(spark, d)).select("key", F.posexplode("pairs").alias("i", "p"))
    return pairs.select("key", "p.field", "p.value", F.col("i").cast("long").alias("i"))


@query(f"{HASH} SELECT key, count(*) AS fields FROM h GROUP BY key")
def hash_hlen(spark: SparkSession, d: str) -> DataFrame:
    return hashes.hlen(hash_hset(spark, d))


def _errors(rows: DataFrame) -> DataFrame:
    return rows.where("field in ('error', 'view')").select("key", "field")


@query(f"{HASH} SELECT key, field, value FROM h WHERE field NOT IN ('error', 'view')")
def hash_hdel(spark: SparkSession, d: str) -> DataFrame:
    rows = hash_hset(spark, d)
    return hashes.hdel(rows, _errors(rows))


@query(f"{HASH} SELECT key, count(*) AS deleted FROM h WHERE field IN ('error', 'view') GROUP BY key")
def hash_hdel_count(spark: SparkSession, d: str) -> DataFrame:
    rows = hash_hset(spark, d)
    return hashes.hdel_count(rows, _errors(rows))


@query("SELECT 'cust:' || c_custkey AS key, count(*) AS fields FROM customer, (VALUES (1), (2), (3)) t(n) GROUP BY 1")
def hash_from_columns(spark: SparkSession, d: str) -> DataFrame:
    """Customers' columns as fields."""
    c = V.table(spark, d, "customer")
    key = F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key")
    rows = c.select(key, "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")).unpivot("key", ["c_name", "c_mktsegment", "c_nationkey"], "field", "value")
    return hashes.hlen(rows)


# ---- lists

LIST = f"""WITH {LOG}, l AS (SELECT key, op AS value, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN seq % 2 = 1 THEN -1 ELSE 1 END,
  CASE WHEN seq % 2 = 1 THEN -us ELSE us END, CASE WHEN seq % 2 = 1 THEN -seq ELSE seq END) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM log)"""


@query(f"{LIST} SELECT key, i, value FROM l")
def list_push_order(spark: SparkSession, d: str) -> DataFrame:
    return lists.pushed(V.list_rows(spark, d))


@query(f"{LIST} SELECT key, i - 1 AS i, value FROM l WHERE i >= 1 AND i <= n - 2")
def list_lrange(spark: SparkSession, d: str) -> DataFrame:
    return lists.lrange(list_push_order(spark, d), 1, -2)


@query(f"{LIST} SELECT key, i - greatest(n - 3, 0) AS i, value FROM l WHERE i >= n - 3")
def list_lrange_tail(spark: SparkSession, d: str) -> DataFrame:
    return lists.lrange(list_push_order(spark, d), -3, -1)


@query(f"{LIST} SELECT key, value FROM l WHERE i = n - 2")
def list_lindex(spark: SparkSession, d: str) -> DataFrame:
    return lists.lindex(list_push_order(spark, d), -2)


@query(f"{LIST} SELECT key, i, CASE WHEN i = 2 THEN 'set' ELSE value END AS value FROM l")
def list_lset(spark: SparkSession, d: str) -> DataFrame:
    return lists.lset(list_push_order(spark, d), 2, "set")


@query(f"{LIST} SELECT key, i, value FROM l WHERE i <= 4")
def list_ltrim(spark: SparkSession, d: str) -> DataFrame:
    return lists.lrange(list_push_order(spark, d), 0, 4)


@query(f"WITH {LOG} SELECT key, count(*) AS n FROM log GROUP BY key")
def list_llen(spark: SparkSession, d: str) -> DataFrame:
    return lists.llen(V.list_rows(spark, d))


@query(f"{LIST} SELECT key, max(CASE WHEN i = 0 THEN value END) AS lpop, max(CASE WHEN i = n - 1 AND i > 0 THEN value END) AS rpop, greatest(max(n) - 2, 0) AS rest FROM l GROUP BY key")
def list_pop(spark: SparkSession, d: str) -> DataFrame:
    return lists.popped(list_push_order(spark, d))


@query(
    f"""WITH RECURSIVE {LOG}, o AS (SELECT key, op AS value, ['RPUSH', 'LPUSH', 'RPUSH', 'LPOP', 'LPUSH', 'RPUSH', 'LPUSH', 'RPOP'][(seq % 8 + 1)::INT] AS cmd, row_number() OVER (PARTITION BY key ORDER BY us, seq) AS rn FROM log),
f(key, rn, l) AS (SELECT DISTINCT key, 0::BIGINT, []::VARCHAR[] FROM o UNION ALL SELECT f.key, f.rn + 1, CASE cmd WHEN 'RPUSH' THEN list_append(l, value) WHEN 'LPUSH' THEN list_prepend(value, l) WHEN 'LPOP' THEN list_slice(l, 2, len(l)) ELSE list_slice(l, 1, greatest(len(l) - 1, 0)) END FROM f JOIN o ON f.key = o.key AND o.rn = f.rn + 1),
e AS (SELECT key, arg_max(l, rn) AS l FROM f GROUP BY key) SELECT key, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS value FROM e"""
)
def list_push_pop_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth command pops."""
    op = F.array(*[F.lit(x) for x in ("RPUSH", "LPUSH", "RPUSH", "LPOP", "LPUSH", "RPUSH", "LPUSH", "RPOP")])
    return lists.replay(V.log(spark, d).select("key", F.get(op, (F.col("seq") % 8).cast("int")).alias("op"), F.col("op").alias("value"), "us", "seq"))


# ---- sets

SET = f"WITH {LOG}, s AS (SELECT DISTINCT 'type:' || op AS key, CAST(user_id AS VARCHAR) AS member FROM log)"


@query(f"{SET} SELECT key, count(*) AS members FROM s GROUP BY key")
def set_sadd_card(spark: SparkSession, d: str) -> DataFrame:
    return sets.scard(V.set_rows(spark, d))


@query(f"{SET} SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS i FROM s")
def set_smembers(spark: SparkSession, d: str) -> DataFrame:
    return sets.smembers(V.set_rows(spark, d))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return V.customer_keys(spark, d).select(F.lit("type:click").alias("key"), F.col("c_custkey").cast("string").alias("member"))


@query(f"{SET}, p AS (SELECT 'type:click' AS key, CAST(c_custkey AS VARCHAR) AS member FROM customer) SELECT p.key, p.member, CAST(s.key IS NOT NULL AS BIGINT) AS found FROM p LEFT JOIN s ON p.key = s.key AND p.member = s.member")
def set_ismember(spark: SparkSession, d: str) -> DataFrame:
    return sets.sismember(V.set_rows(spark, d), _members(spark, d))


@query(f"{SET} SELECT key, member FROM s EXCEPT SELECT 'type:click', CAST(c_custkey AS VARCHAR) FROM customer")
def set_srem(spark: SparkSession, d: str) -> DataFrame:
    return sets.srem(V.set_rows(spark, d), _members(spark, d))


@query(f"{SET} SELECT 'type:click' AS key, count(*) AS added FROM (SELECT CAST(c_custkey AS VARCHAR) AS m FROM customer EXCEPT SELECT member FROM s WHERE key = 'type:click')")
def set_sadd_added(spark: SparkSession, d: str) -> DataFrame:
    return sets.sadd_added(sets.sadd(V.set_rows(spark, d)), _members(spark, d))


@query(f"{SET} SELECT member FROM s WHERE key = 'type:click' UNION SELECT member FROM s WHERE key = 'type:error'")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return sets.union(V.set_rows(spark, d), "type:click", "type:error")


@query(f"{SET} SELECT member FROM s WHERE key = 'type:click' INTERSECT SELECT member FROM s WHERE key = 'type:error'")
def set_inter(spark: SparkSession, d: str) -> DataFrame:
    return sets.inter(V.set_rows(spark, d), "type:click", "type:error")


@query(f"{SET} SELECT member FROM s WHERE key = 'type:click' EXCEPT SELECT member FROM s WHERE key = 'type:error'")
def set_diff(spark: SparkSession, d: str) -> DataFrame:
    return sets.diff(V.set_rows(spark, d), "type:click", "type:error")


@query(f"{SET} SELECT key, member FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5(member), member) > 5")
def set_spop(spark: SparkSession, d: str) -> DataFrame:
    return sets.pop(V.set_rows(spark, d), 5)


@query(f"{SET} SELECT key, member FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5(member), member) <= 5")
def set_srandmember(spark: SparkSession, d: str) -> DataFrame:
    return sets.sample(V.set_rows(spark, d), 5)


# ---- sorted sets

ZSET = f"WITH {LOG}, z AS (SELECT 'type:' || op AS key, key AS member, arg_max(score, (us, seq)) AS score FROM log GROUP BY 1, 2)"


def _zset(spark: SparkSession, d: str) -> DataFrame:
    return zsets.zadd(V.zset_rows(spark, d))


@query(f"{ZSET} SELECT key, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, member, score FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) <= 10")
def zset_range_top(spark: SparkSession, d: str) -> DataFrame:
    return zsets.top(_zset(spark, d), 10)


@query(f"{ZSET} SELECT key, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank, member, score FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) <= 10")
def zset_revrange(spark: SparkSession, d: str) -> DataFrame:
    return zsets.top(_zset(spark, d), 10, descending=True)


@query(f"{ZSET}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM z) SELECT key, rank, member, score FROM r WHERE rank >= n - 7 AND rank <= n - 2")
def zset_range_negative(spark: SparkSession, d: str) -> DataFrame:
    return zsets.zrange(_zset(spark, d), -7, -2)


@query(f"{ZSET} SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM z")
def zset_rank(spark: SparkSession, d: str) -> DataFrame:
    return zsets.ranked(_zset(spark, d))


@query(f"{ZSET} SELECT key, count(*) AS members FROM z GROUP BY key")
def zset_card(spark: SparkSession, d: str) -> DataFrame:
    return zsets.zcard(_zset(spark, d))


@query(f"{ZSET} SELECT key, count(*) FILTER (score BETWEEN 10 AND 50) AS members FROM z GROUP BY key")
def zset_count(spark: SparkSession, d: str) -> DataFrame:
    return zsets.zcount(_zset(spark, d), 10.0, 50.0)


@query(f"WITH {LOG} SELECT 'type:' || op AS key, key AS member, round(sum(score), 4) AS score FROM log GROUP BY 1, 2")
def zset_incrby(spark: SparkSession, d: str) -> DataFrame:
    return zsets.zincrby(V.zset_rows(spark, d)).withColumn("score", F.round("score", 4))


@query(f"{ZSET} SELECT key, member, score FROM z WHERE NOT (key = 'type:click' AND CAST(substr(member, 6) AS BIGINT) % 2 = 0)")
def zset_rem(spark: SparkSession, d: str) -> DataFrame:
    rows = _zset(spark, d)
    return zsets.zrem(rows, rows.where((F.col("key") == "type:click") & (F.substring("member", 6, 20).cast("long") % 2 == 0)).select("key", "member"))


@query(f"{ZSET} SELECT key, member, regexp_replace(CAST(score AS VARCHAR), '\\.0$', '') AS score FROM z WHERE score >= 0.001 AND score < 1000000")
def zset_score_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _zset(spark, d).where("score >= 0.001 and score < 1000000")
    return rows.select("key", "member", plain_double(F.col("score")).alias("score"))


# ---- keys

KEYS = f"""WITH {LOG}, k AS (SELECT DISTINCT key, 'string' AS type FROM log UNION ALL SELECT DISTINCT 'cust:' || c_custkey, 'hash' FROM customer
  UNION ALL SELECT DISTINCT 'list:' || user_id, 'list' FROM log UNION ALL SELECT DISTINCT 'type:' || op, 'set' FROM log UNION ALL SELECT DISTINCT 'rank:' || op, 'zset' FROM log)"""


@query(
    f"""{KEYS}, r AS (SELECT o_orderkey AS request, 'user:' || o_custkey AS key FROM orders, (VALUES (1), (2)) t(n) UNION ALL SELECT o_orderkey, 'cust:' || o_custkey FROM orders)
SELECT request, count(*) FILTER (key IN (SELECT key FROM k)) AS found FROM r GROUP BY request"""
)
def key_exists_dups(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    number = F.col("o_custkey").cast("string")
    names = F.array(F.concat(F.lit("user:"), number), F.concat(F.lit("user:"), number), F.concat(F.lit("cust:"), number))
    return keys.exists(V.typed_keys(spark, d), o.select(F.col("o_orderkey").alias("request"), F.explode(names).alias("key")))


@query(f"{KEYS} SELECT key, type FROM k WHERE key NOT IN (SELECT 'user:' || c_custkey FROM customer)")
def key_del(spark: SparkSession, d: str) -> DataFrame:
    return keys.delete(V.typed_keys(spark, d), _customer_writes(spark, d).select("key"))


@query(f"{KEYS} SELECT type, count(*) AS deleted FROM k WHERE key IN (SELECT 'user:' || c_custkey FROM customer) GROUP BY type")
def key_del_count(spark: SparkSession, d: str) -> DataFrame:
    return keys.delete_count(V.typed_keys(spark, d), _customer_writes(spark, d).select("key"))


@query(f"{KEYS}, p AS (SELECT prefix || c_custkey AS key FROM customer, (VALUES ('user:'), ('list:'), ('none:')) t(prefix)) SELECT p.key, coalesce(type, 'none') AS type FROM p LEFT JOIN k ON p.key = k.key")
def key_type(spark: SparkSession, d: str) -> DataFrame:
    prefixes = F.explode(F.array(F.lit("user:"), F.lit("list:"), F.lit("none:")))
    probes = V.customer_keys(spark, d).select(prefixes.alias("p"), "c_custkey").select(F.concat("p", F.col("c_custkey").cast("string")).alias("key"))
    return keys.type_of(V.typed_keys(spark, d), probes)


@query(f"{KEYS} SELECT key, type FROM k WHERE regexp_full_match(key, 'user:[1-3][^/]*[^5]')")
def key_glob(spark: SparkSession, d: str) -> DataFrame:
    return keys.match(V.typed_keys(spark, d), "user:[1-3]*[^5]")


@query(
    f"""{KEYS}, m AS (SELECT 'user:' || c_custkey AS key, 'list:' || c_custkey AS newkey FROM customer), t AS (SELECT m.newkey AS key, type FROM k JOIN m ON k.key = m.key)
SELECT key, type FROM (SELECT * FROM k ANTI JOIN m USING (key)) s ANTI JOIN t USING (key) UNION ALL SELECT key, type FROM t"""
)
def key_rename(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("c_custkey").cast("string")
    renames = V.customer_keys(spark, d).select(F.concat(F.lit("user:"), number).alias("key"), F.concat(F.lit("list:"), number).alias("newkey"))
    return keys.rename(V.typed_keys(spark, d), renames)


@query(f"{KEYS} SELECT key, type FROM k WHERE key > 'list:2' ORDER BY key LIMIT 25")
def key_scan_page(spark: SparkSession, d: str) -> DataFrame:
    return keys.scan_page(V.typed_keys(spark, d), "list:2", 25)


@query(f"{KEYS} SELECT type, count(*) AS keys FROM k GROUP BY type")
def key_dbsize(spark: SparkSession, d: str) -> DataFrame:
    return keys.dbsize(V.typed_keys(spark, d))


@query(f"{KEYS} SELECT key FROM k ORDER BY md5(key), key LIMIT 10")
def key_random(spark: SparkSession, d: str) -> DataFrame:
    return keys.random_keys(V.typed_keys(spark, d), 10)


@query(f"{KEYS} SELECT key, type FROM k WHERE false")
def key_flush(spark: SparkSession, d: str) -> DataFrame:
    return keys.flush(V.typed_keys(spark, d))


# ---- expiry

TTLS = f"""WITH {LOG}, k AS (SELECT key, arg_max(op, (us, seq)) AS value, CASE WHEN arg_max(seq, (us, seq)) % 3 = 0 THEN NULL ELSE arg_max(us, (us, seq)) + {TTL} END AS expire_at_us FROM log GROUP BY key),
v AS (SELECT * FROM k WHERE expire_at_us IS NULL OR {NOW} <= expire_at_us), p AS (SELECT 'user:' || c_custkey AS key, c_custkey FROM customer)"""


def _expiring(spark: SparkSession, d: str) -> DataFrame:
    rows = V.log(spark, d)
    last = rows.groupBy("key").agg(F.max_by(F.struct("op", "us", "seq"), V.place()).alias("l"))
    return last.select("key", F.col("l.op").alias("value"), F.when(F.col("l.seq") % 3 != 0, F.col("l.us") + V.TTL_US).alias("expire_at_us"))


def _told(rows: DataFrame) -> DataFrame:
    """The expiry as stores tell it: 0 for never."""
    return rows.withColumn("expire_at_us", F.coalesce("expire_at_us", F.lit(0)))


@query(f"{TTLS} SELECT key, value, coalesce(expire_at_us, 0) AS expire_at_us FROM v")
def ttl_visible(spark: SparkSession, d: str) -> DataFrame:
    return _told(expiry.visible(_expiring(spark, d), V.NOW_US))


@query(f"{TTLS} SELECT p.key, CASE WHEN v.key IS NULL THEN -2 WHEN expire_at_us IS NULL THEN -1 ELSE (expire_at_us - {NOW}) // 1000000 END AS ttl FROM p LEFT JOIN v ON p.key = v.key")
def ttl_values(spark: SparkSession, d: str) -> DataFrame:
    return expiry.ttl(_expiring(spark, d), _customer_writes(spark, d).select("key"), V.NOW_US)


@query(f"{TTLS} SELECT p.key, CASE WHEN v.key IS NULL THEN -2000 WHEN expire_at_us IS NULL THEN 0 ELSE (expire_at_us - {NOW}) // 1000 END AS ttl FROM p LEFT JOIN v ON p.key = v.key")
def ttl_values_compat(spark: SparkSession, d: str) -> DataFrame:
    return expiry.ttl(_expiring(spark, d), _customer_writes(spark, d).select("key"), V.NOW_US, 1000, compat=True)


def _ttl_requests(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("seq") % 3
    return _customer_writes(spark, d).select("key", F.when(n == 0, 0).otherwise(n * 1_000_000).cast("long").alias("ttl_us"))


@query(f"{TTLS} SELECT v.key, value, coalesce(CASE WHEN c_custkey IS NULL THEN expire_at_us WHEN c_custkey % 3 > 0 THEN {NOW} + c_custkey % 3 * 1000000 END, 0) AS expire_at_us FROM v LEFT JOIN p ON v.key = p.key")
def ttl_expire(spark: SparkSession, d: str) -> DataFrame:
    return _told(expiry.expire(_expiring(spark, d), _ttl_requests(spark, d), V.NOW_US))


@query(f"{TTLS} SELECT v.key, value, coalesce({NOW} + (c_custkey % 3 - 1) * 1000000, expire_at_us, 0) AS expire_at_us FROM v LEFT JOIN p ON v.key = p.key WHERE c_custkey IS NULL OR c_custkey % 3 = 2")
def ttl_expireat(spark: SparkSession, d: str) -> DataFrame:
    at = _customer_writes(spark, d).select("key", (F.lit(V.NOW_US) + (F.col("seq") % 3 - 1) * 1_000_000).alias("at_us"))
    return _told(expiry.expire_at(_expiring(spark, d), at, V.NOW_US))


@query(f"{TTLS} SELECT k.key, value, coalesce(CASE WHEN c_custkey IS NULL THEN expire_at_us END, 0) AS expire_at_us FROM k LEFT JOIN p ON k.key = p.key")
def ttl_persist(spark: SparkSession, d: str) -> DataFrame:
    return _told(expiry.persist(_expiring(spark, d), _customer_writes(spark, d).select("key")))


@query(f"WITH {LOG} SELECT key, count(*) AS uses FROM log GROUP BY key ORDER BY uses, key LIMIT 20")
def evict_lfu(spark: SparkSession, d: str) -> DataFrame:
    stats = V.log(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    return expiry.evict_lfu(stats, 20)


@query(f"{TTLS}, n AS (SELECT key, count(*) AS uses FROM log GROUP BY key) SELECT key, uses FROM n WHERE key IN (SELECT key FROM k WHERE expire_at_us IS NOT NULL) ORDER BY uses, key LIMIT 20")
def evict_volatile_lfu(spark: SparkSession, d: str) -> DataFrame:
    stats = V.log(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    return expiry.evict_lfu(stats.join(_expiring(spark, d).select("key", "expire_at_us"), "key"), 20, volatile=True)


@query(f"{TTLS} SELECT key FROM k WHERE expire_at_us IS NOT NULL ORDER BY md5(key), key LIMIT 20")
def evict_volatile_random(spark: SparkSession, d: str) -> DataFrame:
    return expiry.evict_random(_expiring(spark, d).where("expire_at_us is not null"), 20)


@query(f"{TTLS} SELECT count(*) FILTER (expire_at_us IS NULL OR {NOW} <= expire_at_us) AS live, count(*) AS raw FROM k")
def key_dbsize_live_raw(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are seen, and those with the ones that have expired and are not swept yet."""
    live = F.col("expire_at_us").isNull() | (F.col("expire_at_us") >= V.NOW_US)
    return _expiring(spark, d).agg(F.count_if(live).alias("live"), F.count(F.lit(1)).alias("raw"))


@query(f"{TTLS} SELECT key, expire_at_us FROM k WHERE expire_at_us IS NOT NULL ORDER BY expire_at_us, key LIMIT 20")
def evict_ttl(spark: SparkSession, d: str) -> DataFrame:
    return expiry.evict_ttl(_expiring(spark, d), 20)


@query(f"{TTLS} SELECT key FROM k ORDER BY md5(key), key LIMIT 20")
def evict_random(spark: SparkSession, d: str) -> DataFrame:
    return expiry.evict_random(_expiring(spark, d), 20)
