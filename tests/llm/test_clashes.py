"""Columns whose names operators use themselves, and numbers that only very large tables reach."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvloom.llm import decontaminate, jaccard, langid, lines, packing, secrets

NAMES = ("id", "mix", "rank", "n", "node", "__words", "__ranges", "__items", "__lang", "__score", "__share", "__doc", "__crc", "__removed", "__kept", "__node", "__chosen", "__DOC_")


@pytest.fixture(scope="module")
def docs(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    return rows.select("*", *[F.lit("own").alias(n) for n in NAMES])


def same(out, docs):
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == "own" for r in rows for n in NAMES)
    return rows


def test_filters_keep_clashing_columns(spark, data, docs):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    same(decontaminate.decontaminate(docs, benchmark), docs)
    same(langid.keep_known(docs), docs)
    same(jaccard.keep_one(docs), docs)
    same(lines.dedup_lines(docs, by="pairs"), docs)


def test_identify_with_clashing_columns(docs):
    plain = docs.drop(*NAMES)
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(df).collect())
    assert key(docs) == key(plain)


def test_a_sample_has_as_many_of_each_language(spark):
    """Many more rows of one language than of another, and null languages, texts and ids."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "b").when(F.col("id") % 50 < 48, "a").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(None, "a", "x"), (3, "a", None)], "doc_id long, lang string, text string"))
    got = langid.sample(rows, "doc_id", "text", "lang", most=200)
    assert len(got) == 200 and abs(sum(x[0] == "a" for x in got) - 100) <= 1
    assert got == langid.sample(rows.repartition(7), "doc_id", "text", "lang", most=200)
    assert langid.sample(rows.limit(0), "doc_id", "text", "lang") == []


def test_sequences_of_large_partition_numbers():
    docs = [np.arange(5, dtype=np.uint16), np.arange(3, dtype=np.uint16)]
    index = packing.Index(docs, np.ones(packing.VOCABULARY, np.float32), 4.0)
    first = packing.first_sequence(600_000, 3)
    pieces = list(packing.pack_shard(["a", "b"], docs, index, first, 4))
    assert [p[5] for p in pieces] == [first, *[first + 1] * (len(pieces) - 1)] and first + 1 < 1 << 63
    numbers = {packing.first_sequence(p, s) >> 20 for p in (0, 1, 600_000, (1 << 26) - 1) for s in (0, 1, (1 << 17) - 1)}
    assert len(numbers) == 12 and max(numbers) << 20 < 1 << 63
    for wrong in ((1 << 26, 0), (0, 1 << 17)):
        with pytest.raises(ValueError):
            packing.first_sequence(*wrong)


def test_cuts_are_those_of_weighted_benjamini_hochberg(spark):
    """Against the procedure on unbinned p-values, whose weights are on average 1; bins may move a p-value by one in their number."""
    rng = random.Random(3)
    cands = [{"start": 0, "end": n, "enc": "hex", "p": p, "bin": secrets._bin(p, n)} for n, p in ((rng.choice([24, 64, 400]), rng.random() ** rng.choice([1, 12])) for _ in range(400))]
    found = spark.createDataFrame([(0, "", 0, 0, 0, cands)], secrets._FOUND)
    cut = secrets.cuts(found, 0.05).first()["cut"]
    weights = np.array([c["end"] for c in cands]) / np.mean([c["end"] for c in cands])
    q = np.sort(np.array([c["p"] for c in cands]) / weights)
    under = np.flatnonzero(q <= 0.05 * np.arange(1, len(q) + 1) / len(q))
    want = under[-1] + 1 if len(under) else 0
    got = sum(c["bin"] >= cut for c in cands)
    assert 0 < got <= want and want - got <= 0.1 * want


def test_names_and_paths_are_no_secrets(spark, docs_of):
    """Planted random secrets are found; names in camel case or with underscores, and paths, are not."""
    rng = random.Random(9)
    syllables = ["get", "user", "name", "list", "of", "items", "from", "cache", "index", "to", "string", "value"]
    word = lambda k: [rng.choice(syllables) for _ in range(k)]
    names = [f"call {''.join(w.title() for w in word(9))} and {'_'.join(word(8))} in /{'/'.join(word(9))} now" for _ in range(300)]
    planted = ["see " + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48)) + " here" for _ in range(60)]
    rows = {r.doc_id: r.spans for r in secrets.find_secrets(docs_of(names + planted)).collect()}
    assert sum("random" in rows[i] for i in range(300)) <= 3
    assert sum("random:4:52" in rows[300 + i] for i in range(60)) >= 54
