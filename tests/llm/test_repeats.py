import hashlib
import random
import re

import numpy as np
import pytest

from kvloom.llm import repeats as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, w in words:
        gone = {p for s in range(len(w) - n + 1) if least[tuple(w[s : s + n])] < i for p in range(s, s + n)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out)


def made(seed, n=150):
    rng = random.Random(seed)
    vocab = ["a", "b", "é", "dd", "x.", " ", "\x1c"]
    text = lambda k: "".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(k))
    common = [text(k) for k in (13, 14, 30, 100)]
    out = ["", None, " \n ", "a " * 12, "a " * 13, "a " * 40, text(3000)]
    for _ in range(n):
        out.append("".join(rng.choice([text(rng.randrange(30)), rng.choice(common), rng.choice(out) or ""]) for _ in range(rng.randrange(1, 4))))
    return out


@pytest.mark.parametrize(("window", "small"), [(13, False), (13, True), (5, False), (50, False), (1, False)])
def test_matches_brute_force(spark, docs_of, monkeypatch, window, small):
    if small:
        monkeypatch.setattr(R, "BATCH_BYTES", 300)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = made(window)
        ids = random.Random(1).sample(range(10**6), len(texts))
        got = R.remove_repeats(docs_of(texts, ids), window).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(list(zip(ids, texts)), window)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute([(r.doc_id, r.text) for r in docs.collect()])]
    got = R.remove_repeats(docs, digest=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_repeated_and_null_ids(spark, docs_of):
    t, u = " ".join(map(str, range(20))), " ".join(map(str, range(5, 30)))
    got = R.remove_repeats(docs_of([t, u, t, t, u], [1, 1, 1, None, 2])).collect()
    assert sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in got) == [(1, 20, 0), (1, 20, 0), (1, 25, 0), (2, 25, 25), (99, 20, 20)]
    assert R.remove_repeats(docs_of([])).count() == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 40).astype(np.uint64)
    for n in (1, 2, 3, 7, 10, 40, 41):
        assert R.sliding_min(x, n).tolist() == [min(x[i : i + n]) for i in range(len(x) - n + 1)]
