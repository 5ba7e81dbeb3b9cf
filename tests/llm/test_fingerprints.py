import hashlib
import re
import unicodedata

import pytest

from kvloom.llm import fingerprints as P

TEXTS = ["Straße", "STRASSE ", "été", "ÉTÉ", "", None, "ﬁne   x\n", "fine x", "Straße", "日本" * 50, "ａ", "a"]


def canon(text):
    once = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", once).strip(" ")


def expected(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, text) in enumerate(rows):
        text = text or ""
        follow = rows[(k + 1) % len(rows)][1] or ""
        m = len(text) // 4
        edited = text[: len(text) - m] + follow[:m]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), canon(text), canon(edited), float(canon(text) == canon(edited)), float(canon(text) == canon(follow)))
    return out


def verify(got, want):
    assert len(got) == len(want)
    names = {}
    for r in got:
        n, sha, form, other, near_edited, near_next = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near_edited, near_next)
        for name, c in ((r.fingerprint, form), (r.edited_fingerprint, other)):
            assert names.setdefault(c, name) == name
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("bits", [1, 16])
def test_matches_brute_force(spark, docs_of, data, monkeypatch, bits):
    monkeypatch.setattr(P, "CELL_BITS", bits)
    rows = [(i * 7 - 20 if i % 2 else i * 7 + (1 << 40), t) for i, t in enumerate(TEXTS)]
    if bits == 16:
        rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = P.fingerprints(docs_of([t for _, t in rows], [i for i, _ in rows])).collect()
    verify(got, expected(rows))


def test_colliding_buckets_are_told_apart(spark, docs_of, monkeypatch):
    monkeypatch.setattr(P, "wide_hash", lambda form: [P.F.length(form).cast("long"), P.F.lit(0).cast("long")])
    rows = [(i, t) for i, t in enumerate(["ab", "AB", "cd", "ef ", "abc", "x"])]
    verify(P.fingerprints(docs_of([t for _, t in rows])).collect(), expected(rows))


def test_null_and_repeated_ids(spark, docs_of):
    got = P.fingerprints(docs_of(["aaaa", "bbbb", "bbbb", "cccc", "dddd"], [None, 1, 1, None, 2])).collect()
    edits = sorted((r.doc_id or -1, r.edited_sha256) for r in got)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert edits == sorted([(-1, sha("aaab")), (-1, sha("cccb")), (1, sha("bbbd")), (1, sha("bbbd")), (2, sha("ddda"))])


def test_one_document_and_none(spark, docs_of):
    one = P.fingerprints(docs_of(["abcd"])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abca").hexdigest()
    assert P.fingerprints(docs_of([])).count() == 0
