import numpy as np
import pytest

from kvloom.llm import tokens as K

TEXTS = ["One two. Three four!  Five\n\nSix 7.8 é日本. x", "", None, "\n", "no end", "a. " * 500, "Ünï. çø?de\n"]


def brute(heads, text, rule, encoding):
    whole = "".join(f"{h}\n" for h in heads) + text
    stops = K.sections(text) if text else []
    bounds = np.cumsum([0, *(len(h.encode()) + 1 for h in heads)]).tolist()
    bounds += [bounds[-1] + len(text[:s].encode()) for s in stops]
    owner = [s for s in range(len(bounds) - 1) for _ in range(bounds[s + 1] - bounds[s])]
    counts, at = [0.0] * (len(bounds) - 1), 0
    ids = encoding.encode_ordinary(whole)
    for i in ids:
        over = owner[at : at + len(encoding.decode_single_token_bytes(i))]
        at += len(over)
        if rule == "start":
            counts[over[0]] += 1
        elif rule == "majority":
            counts[max(sorted(set(over)), key=over.count)] += 1
        else:
            for s in over:
                counts[s] += 1 / len(over)
    assert at == len(owner) == len(whole.encode())
    return len(ids), counts, stops


@pytest.mark.parametrize("rule", K.RULES)
def test_matches_brute_force(spark, docs_of, data, rule):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(25).collect()]
    encoding, _ = K.byte_encoder(K.vocabulary("byte_bpe_50k.tiktoken"))
    got = K.count_tokens(docs_of(texts), rule=rule, fields=("source", "lang", "nowhere")).collect()
    assert len(got) == len(texts)
    for r in got:
        n, counts, stops = brute(["s", "", ""], texts[r.doc_id] or "", rule, encoding)
        assert r.n_tokens == n and r.section_ends == stops
        assert np.allclose(r.field_tokens + r.section_tokens, counts)
        assert np.isclose(sum(r.field_tokens) + r.text_tokens, n)


def test_empty_table(docs_of):
    assert K.count_tokens(docs_of([])).count() == 0
