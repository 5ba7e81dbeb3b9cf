import hashlib
import random
import re

import pytest

from kvloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(window, len(w))
        if not n:
            continue
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(name or "")
    return len(own), hit, found


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    vocab = ["a", "b", "c", "dé", "É", "x1", "zz"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(str(i), text(rng.choice([1, 3, 9, 10, 11, 25, 40]) if i else 14)) for i in range(12)]
    items += [("twin", items[0][1]), ("empty", ""), ("null", None), (None, "Q w e r t y u i o p a s")]
    docs = ["", None, "...", text(2000), items[0][1].upper().replace(" ", ",\n"), "q W e R t y u i o P a s"]
    for _ in range(60):
        inner = rng.choice(items[:12])[1].split()
        a = rng.randrange(len(inner))
        docs.append(text(rng.randrange(20)) + " " + " ".join(inner[a : a + rng.randrange(30)]) + " " + text(rng.randrange(20)))
    return items, docs


@pytest.mark.parametrize("least", [1, 10])
def test_matches_brute_force(spark, docs_of, cases, least):
    items, docs = cases
    items = [(i, t) for i, t in items if t is None or not t or len(t.split()) >= least]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in D.contamination(docs_of(docs), bench).collect()}
    assert len(got) == len(docs)
    for i, text in enumerate(docs):
        n, hit, found = brute(text, items)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, len(hit), len(found), sha, bool(hit)), (text, found)


def test_several_automata_give_the_same(spark, docs_of, cases, monkeypatch):
    items, docs = cases
    bench = spark.createDataFrame([x for x in items if x[1] and len(x[1].split()) >= 10], "item_id string, text string")
    one = sorted(D.contamination(docs_of(docs), bench).collect())
    monkeypatch.setattr(D, "SHARD_BYTES", 300)
    assert sorted(D.contamination(docs_of(docs), bench).collect()) == one


def test_spans_go_and_clean_documents_stay(spark, docs_of):
    item = "one two three four five six seven eight nine ten eleven"
    clean = "some clean  text,\n\nwith spaces that nothing touches at all"
    docs = docs_of([clean, None, "", item, f"Here: {item.title()}! and {clean}"])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r for r in D.decontaminate(docs, bench).collect()}
    assert set(out) == {0, 1, 2, 4}
    assert out[0].text == clean and out[1].text is None and out[2].text == ""
    assert out[4].text == f"Here: ! and {clean}" and out[4].n_chars == len(out[4].text)
    assert D.decontaminate(docs, bench).columns == docs.columns
    assert D.decontaminate(docs, bench.limit(0)).count() == 5
    assert D.contamination(docs.limit(0), bench).count() == 0
