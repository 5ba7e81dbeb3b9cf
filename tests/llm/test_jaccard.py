import random
import re
from collections import defaultdict

import numpy as np
import pytest

from kvloom.llm import jaccard as J
from kvloom.llm.shared import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(text, n=5):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 10 * threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    return sorted((rows[k][0], min(members[find(k)]), links[k]) for k in range(len(rows)))


def made(seed=3, n=200):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage = text(60)
    out = ["", None, "...", "one two", "One, two!", "two one", "a b c d e", "a b c d e f"]
    family = text(120)
    for _ in range(n // 2):
        w = list(family)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    for _ in range(n // 4):
        out.append(" ".join(text(30) + passage + text(rng.randrange(10))))
    for _ in range(n // 4):
        w = (rng.choice(out) or "x").split()
        out.append(" ".join(w[: rng.randrange(1, len(w) + 1)] + text(rng.randrange(3))))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, docs_of, monkeypatch, small):
    if small:  # everything in blocks
        for name, value in (("CHUNK", 16), ("VERIFIED", 8), ("SMALL", 3)):
            monkeypatch.setattr(J, name, value)
    texts = made()
    ids = random.Random(2).sample(range(10**5), len(texts))
    got = J.classes(docs_of(texts, ids)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(list(zip(ids, texts)))


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = J.classes(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_of_each_stays(spark, docs_of):
    texts = ["a b c d e f g", "A b c d e f g!", None, "", "x y z", "x y z", "q r s t u v", None]
    ids = [5, 3, 7, 8, 1, 1, None, None]
    docs = docs_of(texts, ids)
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, ""), (-1, "q r s t u v"), (1, "x y z"), (3, "A b c d e f g!"), (7, ""), (8, "")]
    assert J.keep_one(docs.limit(0)).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(0)
    least = J.needed(0.8)
    assert all(m <= n * 0.8 for n, m in least) and least[-1][1] > 0.55 * J.VALUES
    sig = rng.integers(0, 256, (2000, J.VALUES), dtype=np.uint8)
    twins = np.where(rng.random(sig.shape) < 0.8, sig, rng.integers(0, 256, sig.shape)).astype(np.uint8)
    both = np.concatenate((sig, twins))
    i, _ = J.prune(both, np.arange(2000), np.arange(2000) + 2000, least)
    assert len(i) == 2000
    i, _ = J.prune(both, np.arange(1999), np.arange(1, 2000), least)
    assert not len(i)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
