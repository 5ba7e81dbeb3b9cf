import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from kvloom.llm import packing as P
from kvloom.llm import textops as T
from kvloom.llm.tokens import WordEncoder, vocabulary

ODD = ["", None, " \n\t", "it's we'll <|endoftext|> <|ENDOFTEXT|> 12345 a b c", "Été ΑΣ ΑΣ. İß\x1c\x85x", "日本語 ｶﾞ ﬁ", "x" * 30000, "a " * 9000, "end. End., e. . , é. x.y, don't. =\u0338 a.\u0338 a\u0301.", "abcdefgh abcdefghi abcdefghijklmnop abcdefghijklmnopq abcdefghijklmnopqrstuvwx abcdefghijklmnopqrstuvwxy abcdefghXXabcdefghijklmn"]


@pytest.fixture(scope="module")
def texts(spark, data):
    return [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]


def test_ids_are_the_tokenizers(texts):
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    parts = [(t or "").encode() for t in ODD + texts[:80]]
    ids, bounds = WordEncoder(vocabulary("word_bpe_49k.json")).encode(parts)
    for part, a, b in zip(parts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(part.decode(), add_special_tokens=False).ids


def test_round_trip_and_no_padding(spark, docs_of, texts, monkeypatch):
    monkeypatch.setattr(P, "SHARD_DOCS", 40)
    docs = ODD + texts[:120] + texts[:3]
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in docs]
    rows = P.pack(docs_of(docs), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, ids in enumerate(want):
        pieces = sorted(by_doc[i])
        assert [x for _, p, _ in pieces for x in p] == ids and {n for *_, n in pieces} == {len(ids)}
        assert [s for s, _, _ in pieces] == np.cumsum([0, *(len(p) for _, p, _ in pieces)])[:-1].tolist()
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_scores_are_bm25(texts):
    """The index finds what a scan of all documents finds."""
    ids, bounds = WordEncoder(vocabulary("word_bpe_49k.json")).encode([t.encode() for t in texts[:60]])
    docs = [np.append(ids[a:b], np.uint16(1)) for a, b in zip(bounds, bounds[1:])]
    idf = np.random.default_rng(1).random(P.VOCABULARY).astype(np.float32)
    mean = float(np.mean([len(d) for d in docs]))
    index = P.Index(docs, idf, mean)
    counts = [dict(zip(*np.unique(d, return_counts=True))) for d in docs]
    for d in range(0, 60, 7):
        want = [sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for t in counts[d] if t in c) for i, c in enumerate(counts)]
        assert np.allclose(index.scores(d), want, rtol=1e-4)


def test_neighbours_share_words(spark):
    rng = np.random.default_rng(3)
    docs = [rng.integers(g * 500, g * 500 + 500, 400).astype(np.uint16) for g in [0, 1, 2] * 20]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=P.VOCABULARY)
    order = P.order(docs, P.Index(docs, np.log1p((60 - df + 0.5) / (df + 0.5)).astype(np.float32), 400.0), 2048)
    assert sorted(order) == list(range(60))
    assert sum(a % 3 != b % 3 for a, b in zip(order, order[1:])) <= 4


def test_empty_table(spark, docs_of):
    assert P.pack(docs_of([])).count() == 0


def test_groups_cover_all():
    parts = [b"x" * n for n in (0, 5, 100, 3, 0)]
    assert [i for a, b in T.groups(parts, 6) for i in range(a, b)] == list(range(5))


def test_neighbours_are_in_one_shard_whatever_the_file_order(docs_of, texts, monkeypatch):
    """Of the five best BM25 neighbours over all documents, many are in a document's shard, though files mix the topics."""
    monkeypatch.setattr(P, "SHARD_DOCS", 40)
    rng = np.random.default_rng(5)
    own = sorted({w for t in texts[:150] for w in (t or "").split() if w.isascii() and w.isalpha()})
    topics = [rng.choice(own, 40) for _ in range(12)]
    docs = [" ".join(rng.choice(topics[i % 12], 60)) for i in range(360)]
    pieces = P.pack(docs_of(docs), with_ids=True).collect()
    shard, ids = {}, defaultdict(list)
    for r in sorted(pieces, key=lambda r: r.start):
        shard[r.doc_id] = r.sequence_id >> 20
        ids[r.doc_id].append(np.frombuffer(r.ids, "<u4").astype(np.uint16))
    all_ids = [np.concatenate(ids[i]) for i in range(360)]
    df = np.bincount(np.concatenate([np.unique(d) for d in all_ids]), minlength=P.VOCABULARY)
    index = P.Index(all_ids, np.log1p((360 - df + 0.5) / (df + 0.5)).astype(np.float32), float(np.mean([len(d) for d in all_ids])))
    found = []
    for d in range(360):
        scores = index.scores(d)
        scores[d] = -1
        found += [shard[d] == shard[n] for n in np.argsort(-scores)[:5].tolist()]
    print("share", np.mean(found), len(set(shard.values())))
    assert len(set(shard.values())) >= 9 and np.mean(found) >= 0.25  # by chance, one in nine
