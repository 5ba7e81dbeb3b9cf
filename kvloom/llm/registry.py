"""The training-data queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kvloom.llm import decontaminate, fingerprints, jaccard, langid, lines, packing, repeats, secrets, sharding, tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), shards=40)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_documents(spark, sf_dir), by="pairs")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_documents(spark, sf_dir), digest=True)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_documents(spark, sf_dir))


QUERIES = (op1_sharding, op2_line_dedup, op3_language_id, op4_token_counts, op5_substring_dedup, op6_decontamination, op7_ngram_jaccard, op8_packing, op9_secret_scans, op10_fingerprints)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


#: Fixed by the contract: what parts words, and the window's words.
REPEATED = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 12), ' ') AS win FROM w, unnest(range(1, len(ws) - 11)) t(p) WHERE len(ws) >= 13),
m AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
c AS (SELECT DISTINCT doc_id, q AS i FROM (SELECT doc_id, p FROM g JOIN m USING (win) WHERE doc_id > least), unnest(range(p, p + 13)) u(q)),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) x
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND c.i = x.i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATED = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
i AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(list_slice(ws, p, p + least(len(ws), 10) - 1), ' ') AS win FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(p) WHERE len(ws) > 0),
l AS (SELECT DISTINCT n FROM i),
d AS (SELECT doc_id, p, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS win FROM w, l, unnest(range(1, len(ws) - n + 2)) t(p) WHERE len(ws) >= n),
h AS (SELECT doc_id, p, d.n, item FROM d JOIN i ON d.win = i.win AND d.n = i.n),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM h), unnest(range(p, p + n)) u(q) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw ON w.doc_id = hw.doc_id LEFT JOIN hi ON w.doc_id = hi.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose every column SQL can tell. The others have choices of their own (hashes, models, an order of
    packing, names of groups); tests/llm holds them against brute force."""
    return {"op5_substring_dedup": REPEATED, "op6_decontamination": CONTAMINATED}
