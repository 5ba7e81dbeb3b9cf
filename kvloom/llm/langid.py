"""Operator 3: the language of whole documents, by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample.
It labels every byte of a text: the text is cut into windows, in each of which a
forward and a backward pass begin anew, and every position gets a probability for each
language. A document's probabilities are the means over all of its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.llm import textops as T
from kvloom.llm.shared import fresh

#: The training sample: at most so many documents, dealt evenly over languages, and so many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 2048, 384
#: Units of each direction, and the window in bytes.
UNITS, WINDOW = 8, 128
BATCH, STEPS, RATE, SEED = 128, 260, 0.02, 11
#: Windows that go through the network together.
TOGETHER = 2048
UNDETERMINED = "und"


def _direction(rng: np.random.Generator, units: int) -> dict[str, np.ndarray]:
    return {
        "x": rng.normal(0, 0.3, (3 * units, 256)),
        "u": rng.normal(0, 1 / np.sqrt(units), (3 * units, units)),
        "c": np.zeros((units, 1)),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(p: dict[str, np.ndarray], seq: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step, (steps + 1, units, batch), and what the way back needs."""
    steps, batch = seq.shape
    n = p["u"].shape[1]
    h = np.zeros((steps + 1, n, batch))
    kept = []
    for t in range(steps):
        x, a = p["x"][:, seq[t]], p["u"] @ h[t]
        zr = _sigmoid(x[: 2 * n] + a[: 2 * n])
        z, r = zr[:n], zr[n:]
        an = a[2 * n :] + p["c"]
        new = np.tanh(x[2 * n :] + r * an)
        h[t + 1] = new + z * (h[t] - new)
        kept.append((z, r, an, new))
    return h, kept


def _backward(p: dict[str, np.ndarray], seq: np.ndarray, h: np.ndarray, kept: list, out: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients, from those of the states after each step."""
    steps, batch = seq.shape
    n = p["u"].shape[1]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    into = np.empty((steps, 3 * n, batch))
    dh = np.zeros((n, batch))
    for t in reversed(range(steps)):
        z, r, an, new = kept[t]
        dh = dh + out[t]
        d_new = dh * (1 - z) * (1 - new * new)
        d_z = dh * (h[t] - new) * z * (1 - z)
        d_r = d_new * an * r * (1 - r)
        d_an = d_new * r
        into[t] = np.concatenate((d_z, d_r, d_new))
        d_a = np.concatenate((d_z, d_r, d_an))
        grad["u"] += d_a @ h[t].T
        grad["c"] += d_an.sum(1, keepdims=True)
        dh = dh * z + p["u"].T @ d_a
    flat, codes = into.transpose(1, 0, 2).reshape(3 * n, -1), seq.reshape(-1)
    for i in range(3 * n):
        grad["x"][i] = np.bincount(codes, flat[i], 256)
    return grad


class Model:
    """The network and the languages it has learned."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.parts = {"f": _direction(rng, units), "b": _direction(rng, units), "o": {"v": rng.normal(0, 0.3, (len(languages), 2 * units)), "d": np.zeros((len(languages), 1))}}

    def gradients(self, seq: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions of the batch, and its gradients. seq: (steps, batch) bytes."""
        steps, batch = seq.shape
        back = seq[::-1]
        hf, kf = _forward(self.parts["f"], seq)
        hb, kb = _forward(self.parts["b"], back)
        both = np.concatenate((hf[1:], hb[1:][::-1]), axis=1)  # (steps, 2 units, batch)
        v, d = self.parts["o"]["v"], self.parts["o"]["d"]
        logits = v @ both + d
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        loss = -np.log(np.maximum(prob[:, label, np.arange(batch)], 1e-12)).mean()
        prob[:, label, np.arange(batch)] -= 1
        prob /= steps * batch
        d_both = v.T @ prob
        n = v.shape[1] // 2
        grads = {
            "f": _backward(self.parts["f"], seq, hf, kf, d_both[:, :n]),
            "b": _backward(self.parts["b"], back, hb, kb, d_both[::-1, n:]),
            "o": {"v": np.einsum("slb,sub->lu", prob, both), "d": prob.sum((0, 2))[:, None]},
        }
        return loss, grads

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> None:
        """Adam on batches of windows (rows of bytes)."""
        rng = np.random.default_rng(seed)
        m = {k: {n: np.zeros_like(a) for n, a in p.items()} for k, p in self.parts.items()}
        v = {k: {n: np.zeros_like(a) for n, a in p.items()} for k, p in self.parts.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            _, grads = self.gradients(windows[pick].T.astype(np.int64), labels[pick])
            size = np.sqrt(sum(float((g * g).sum()) for p in grads.values() for g in p.values()))
            scale = min(1.0, 1.0 / max(size, 1e-9))
            now = rate * (1 - 0.9 * step / steps)
            for k, p in self.parts.items():
                for name, a in p.items():
                    g = grads[k][name] * scale
                    m[k][name] = 0.9 * m[k][name] + 0.1 * g
                    v[k][name] = 0.99 * v[k][name] + 0.01 * g * g
                    a -= now * (m[k][name] / (1 - 0.9**step)) / (np.sqrt(v[k][name] / (1 - 0.99**step)) + 1e-8)


class Labeller:
    """The trained network for use: single precision, gates scaled so that both sigmoids are one tanh."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.directions = []
        for k in "fb":
            p = model.parts[k]
            n = p["u"].shape[1]
            half = np.ones((3 * n, 1))
            half[: 2 * n] = 0.5
            self.directions.append(tuple(np.ascontiguousarray(a, np.float32) for a in (p["x"] * half, p["u"] * half, p["c"])))
        self.units = n
        self.v = [np.ascontiguousarray(a, np.float32) for a in np.split(model.parts["o"]["v"], 2, axis=1)]
        self.d = model.parts["o"]["d"].astype(np.float32)

    def _states(self, which: int, seq: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        """(steps, units, batch) states of one direction, in the order of the steps. Backwards, a state is 0 where nothing is real yet."""
        x_table, u, c = self.directions[which]
        steps, batch = seq.shape
        n = self.units
        out = np.empty((steps, n, batch), np.float32)
        h = np.zeros((n, batch), np.float32)
        x, a, new = np.empty((3 * n, batch), np.float32), np.empty((3 * n, batch), np.float32), np.empty((n, batch), np.float32)
        for t in range(steps) if which == 0 else reversed(range(steps)):
            np.take(x_table, seq[t], axis=1, out=x, mode="clip")
            np.matmul(u, h, out=a)
            gates = a[: 2 * n]
            gates += x[: 2 * n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.add(a[2 * n :], c, out=new)
            new *= a[n : 2 * n]
            new += x[2 * n :]
            np.tanh(new, out=new)
            h = out[t]
            prior = out[t - 1] if which == 0 and t else out[t + 1] if which and t + 1 < steps else np.float32(0)
            np.subtract(prior, new, out=h)
            h *= a[:n]
            h += new
            if which and real is not None:
                h *= real[t]
        return out

    def positions(self, seq: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """(languages, steps, batch) probabilities. seq: (steps, batch) bytes, of which those that are real count; a window's come first."""
        forward, back = self._states(0, seq, real), self._states(1, seq, real)
        logits = np.matmul(self.v[0], forward)
        logits += np.matmul(self.v[1], back)
        logits += self.d
        np.exp(logits, out=logits)  # a state is within 1, so this is bounded
        logits /= logits.sum(1, keepdims=True)
        return logits.transpose(1, 0, 2)

    def documents(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean probabilities and shares of positions with that label; zero for an empty text."""
        k = len(self.languages)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts) + bytes(WINDOW), np.uint8)
        begins = np.cumsum(lengths) - lengths
        per = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(parts)), per)
        inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        starts = begins[owner] + inner * WINDOW
        sizes = np.minimum(WINDOW, lengths[owner] - inner * WINDOW)
        order = np.argsort(-sizes, kind="stable")  # windows of like length together
        sums, votes = np.zeros((len(parts), k)), np.zeros((len(parts), k))
        for a in range(0, len(order), TOGETHER):
            at = order[a : a + TOGETHER]
            offsets = np.arange(sizes[at[0]])[:, None]
            seq = data[starts[at][None, :] + offsets].astype(np.int64)
            real = offsets < sizes[at][None, :] if sizes[at[-1]] < sizes[at[0]] else None
            prob = self.positions(seq, real)
            best = prob.max(0)
            for lang in range(k):
                chance, label = prob[lang], prob[lang] == best
                if real is not None:
                    chance, label = chance * real, label & real
                sums[:, lang] += np.bincount(owner[at], chance.sum(0, dtype=np.float64), len(parts))
                votes[:, lang] += np.bincount(owner[at], np.count_nonzero(label, axis=0), len(parts))
        total = np.maximum(lengths, 1)[:, None]
        return sums / total, votes / total


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``most`` (language, passage) pairs, by the hash of the id, with as many of each language as there are up to an even share."""
    rows = docs.where(trained(id_col)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    mix = F.xxhash64("id", F.lit(SEED))
    # of each language, only the hashes that are small enough for a few times the sample are looked at, so no task orders more
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    limit = F.least(F.lit(1.0), F.lit(4.0 * most) / F.col("n")) * F.lit(2.0**64) - F.lit(2.0**63)
    near = rows.join(counts, "lang").where(mix <= limit)
    start = F.lit(1) + F.pmod(mix, F.greatest(F.lit(1), F.length("text") - chars)).cast("int")
    passages = near.select("lang", "id", mix.alias("mix"), F.col("text").substr(start, F.lit(chars)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mix", "id"))
    chosen = passages.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("rank", "mix", "id").limit(most)
    return sorted((r.lang, r.text) for r in chosen.select("lang", "text").collect())


def trained(id_col: str):
    """Whether a row may be learned from: the CRC-32 of its id's text modulo 4 is not 2."""
    return F.coalesce(~_held_out(id_col), F.lit(False))


def _held_out(id_col: str):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2


def fit(passages: list[tuple[str, str]], **options) -> Model | None:
    """A model of the passages' languages; None if there are no passages."""
    windows, labels = [], []
    languages = sorted({lang for lang, _ in passages})
    for lang, text in passages:
        raw = text.encode()
        for a in range(0, len(raw), WINDOW):
            piece = raw[a : a + WINDOW]
            if len(piece) >= 8:
                windows.append((piece * (-(-WINDOW // len(piece))))[:WINDOW])
                labels.append(languages.index(lang))
    if not windows:
        return None
    labels_array = np.array(labels)
    # as many windows of each language
    most = np.bincount(labels_array).max()
    index = np.concatenate([np.resize(np.flatnonzero(labels_array == k), most) for k in np.unique(labels_array)])
    model = Model(languages)
    model.train(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)[index], labels_array[index], **options)
    return model


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "share")) -> DataFrame:
    """The rows with the language of each text, its mean probability and the share of positions with that label.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else Labeller(model))  # some 100 KB
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.enter("langid")
        labeller = shared.value
        for batch in batches:
            parts = T.slices(batch.column(text_at))
            letters = [_has_letter(t.as_py()) for t in batch.column(text_at)]
            langs, scores, shares = [], [], []
            for a, b in T.groups(parts) if labeller else []:
                prob, votes = labeller.documents(parts[a:b])
                best = prob.argmax(1)
                at = np.arange(b - a)
                langs += [labeller.languages[i] for i in best]
                scores += np.clip(prob[at, best], 0, 1).tolist()
                shares += votes[at, best].tolist()
            langs, scores, shares = langs or [UNDETERMINED] * len(parts), scores or [0.0] * len(parts), shares or [0.0] * len(parts)
            langs = [x if k else UNDETERMINED for x, k in zip(langs, letters)]
            scores = [x if k else 0.0 for x, k in zip(scores, letters)]
            shares = [x if k else 0.0 for x, k in zip(shares, letters)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], names=[*batch.schema.names, *names])

    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(0.0).alias(names[2])).schema
    for field in schema.fields[-3:]:
        field.nullable = True
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and share of each row.

    held_out rows are never learned from; a null id is neither held out nor learned from. Only
    the text decides a prediction. Repeated rows get the same one each.
    """
    model = fit(sample(docs, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(_held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "share")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.35) -> DataFrame:
    """The documents whose language is known; columns stay as they are.

    What is rejected: texts that are null or have no letter, and those whose best language has a mean probability under ``least``.
    """
    model = fit(sample(docs, id_col, text_col, lang_col))
    names = tuple(fresh(docs, "__lang", "__score", "__share"))
    return predict(docs, model, text_col, names).where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least)).drop(*names)
