import zlib

import numpy as np
import pytest

from kvloom.llm import langid as L


@pytest.fixture(scope="module")
def model(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    return L.fit(L.sample(docs, "doc_id", "text", "lang"))


def slow_positions(model, raw):
    """One window, a position at a time, from the definition."""
    states = []
    for k, seq in (("f", raw), ("b", raw[::-1])):
        p, out = model.parts[k], []
        n = p["u"].shape[1]
        h = np.zeros(n)
        for byte in seq:
            x, a = p["x"][:, byte], p["u"] @ h
            z, r = 1 / (1 + np.exp(-(x[:n] + a[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + a[n : 2 * n])))
            new = np.tanh(x[2 * n :] + r * (a[2 * n :] + p["c"][:, 0]))
            h = (1 - z) * new + z * h
            out.append(h)
        states.append(out)
    logits = [model.parts["o"]["v"] @ np.concatenate(fb) + model.parts["o"]["d"][:, 0] for fb in zip(states[0], states[1][::-1])]
    return np.array([np.exp(x) / np.exp(x).sum() for x in logits])


def test_batched_labels_are_the_definitions(model):
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(32, 120, n).tolist()) for n in (0, 1, 5, 127, 128, 129, 300, 64)]
    means, votes = L.Labeller(model).documents(parts)
    for raw, mean, vote in zip(parts, means, votes):
        each = [slow_positions(model, raw[a : a + L.WINDOW]) for a in range(0, len(raw), L.WINDOW)]
        want = np.concatenate(each).mean(0) if raw else np.zeros(len(model.languages))
        assert np.allclose(mean, want, atol=1e-4)
        assert np.isclose(vote.sum(), 1 if raw else 0)


def test_gradients():
    model, rng = L.Model(["a", "b", "c"], 3), np.random.default_rng(0)
    seq, labels = rng.integers(0, 256, (6, 5)), np.array([0, 1, 2, 1, 0])
    _, grads = model.gradients(seq, labels)
    for k, part in model.parts.items():
        for name, a in part.items():
            i = np.unravel_index(np.abs(grads[k][name]).argmax(), a.shape)
            losses = []
            for step in (1e-5, -1e-5):
                a[i] += step
                losses.append(model.gradients(seq, labels)[0])
                a[i] -= step
            assert np.isclose((losses[0] - losses[1]) / 2e-5, grads[k][name][i], rtol=1e-4)


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert np.mean(held) > 0.97, np.mean(held)


def test_edges(spark, docs_of, model):
    texts = ["", None, "123 !!!", " \n", "The and of that this with the", "é" * 5000]
    out = {r.doc_id: r for r in L.predict(docs_of(texts), model).collect()}
    assert [out[i].lang_pred for i in range(4)] == ["und"] * 4 and out[1].score == 0
    assert out[4].lang_pred in model.languages and out[5].lang_pred in model.languages
    # nothing to learn from
    assert {r.lang_pred for r in L.identify(docs_of(texts)).collect()} == {"und"}
    assert L.identify(docs_of([])).count() == 0
    assert L.keep_known(docs_of(texts)).columns == docs_of(texts).columns
