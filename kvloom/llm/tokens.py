"""Encoding by public tokenizers, and operator 4: tokens attributed to parts of documents."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm import textops as T

#: ASCII blanks that no token of the word tokenizer spans, so what is between two of them is encoded alone.
CUTS = np.zeros(256, bool)
CUTS[[0x20, 0x09, 0x0A, 0x0D]] = True
#: Lower case for ASCII, as the word tokenizer's normaliser has it.
LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
#: A special token, which parts what stands before it from what follows.
APART = "<|startoftext|>"
#: Places for remembered chunks (a power of two), the longest that is remembered, and ids kept before a worker begins anew.
PLACES, LONGEST, POOL = 1 << 20, 24, 1 << 23
#: Chunks that go to the tokenizer together.
LEARNED = 8192
PAD = 8


def vocabulary(name: str) -> str:
    """The path of a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class WordEncoder:
    """Ids of whole texts by a tokenizer that lowers case, drops white space and never looks across it.

    So a text's ids are those of its chunks, one after the other. A worker remembers chunks of
    up to LONGEST bytes, compared byte by byte as three 64-bit words and their length, in
    a table of fixed size. A full stop or comma that ends a chunk after an ASCII
    letter or digit is a piece of its own, and left out of what is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = self.tokenizer.token_to_id(APART)
        self.stops = {c: self.tokenizer.encode(chr(c), add_special_tokens=False).ids for c in b".,"}
        self._clear()
        T.trim()  # what reading the vocabulary took

    def _clear(self) -> None:
        self.keys = [np.zeros(PLACES, np.uint64) for _ in range(3)]
        self.sizes = np.zeros(PLACES, np.uint8)
        self.begins = np.zeros(PLACES, np.uint32)
        self.counts = np.zeros(PLACES, np.uint16)
        self.pool = np.zeros(1 << 18, np.uint16)
        self.used = 0

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each chunk begin in the pool, and how many there are."""
        begins, counts = zip(*(self._learn_some(chunks[a : a + LEARNED]) for a in range(0, len(chunks), LEARNED)))
        return np.concatenate(begins), np.concatenate(counts)

    def _learn_some(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode() for c in chunks]
        if any("<|" in t for t in texts):  # may hold special tokens itself
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
            ids = np.fromiter((i for e in encoded for i in e), np.uint16, int(counts.sum()))
        else:
            joined = [APART.join(texts[i : i + 256]) + APART for i in range(0, len(texts), 256)]
            flat = np.concatenate([np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(flat == self.apart)
            counts = np.diff(ends, prepend=-1) - 1
            ids = flat[flat != self.apart].astype(np.uint16)
        begins = self.used + np.cumsum(counts) - counts
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return begins, counts

    def encode(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the n + 1 bounds of each text's."""
        if self.used > POOL:
            self._clear()
        x = T.Texts(parts)
        starts, ends, first = x.words(CUTS)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(parts) + 1, np.int64)
        special = b"<|" in x.joined
        raw = bytes(PAD) + (x.joined if special else x.joined.translate(LOWER)) + bytes(PAD)
        data = np.frombuffer(raw, np.uint8)
        starts, ends = starts + PAD, ends + PAD
        last = data[ends - 1]
        stop = ((last == 0x2E) | (last == 0x2C)) & ALNUM[data[ends - 2]] & (ends - starts > 1)
        ends = ends - stop
        begins, counts = self._find(raw, starts, ends)
        total = counts + stop
        after = np.concatenate(([0], np.cumsum(total)))
        # the last of a chunk with a stop is read past its own ids, then replaced
        at = np.arange(after[-1]) + np.repeat(begins - after[:-1], total)
        np.minimum(at, len(self.pool) - 1, out=at)
        ids = self.pool[at]
        tails = after[1:][stop] - 1
        kinds = last[stop]
        for c, own in self.stops.items():
            ids[tails[kinds == c]] = own[0]
        return ids, after[first]

    def _find(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        sizes = ends - starts
        head = eight[starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(sizes, 8).astype(np.uint64) * np.uint64(8)))
        tail = np.where(sizes > 8, eight[ends - 8], np.uint64(0))
        middle = np.where(sizes > 16, eight[np.minimum(starts + 8, len(eight) - 1)], np.uint64(0))
        keys = (head, middle, tail)
        h = T.mix((head * np.uint64(T.MULTIPLIERS[0])) ^ T.mix(tail + sizes.astype(np.uint64)) ^ (middle * np.uint64(T.MULTIPLIERS[1])))
        place = (h % np.uint64(PLACES)).astype(np.int64)
        long = sizes > LONGEST
        hit = (self.sizes[place] == sizes) & ~long
        for have, want in zip(self.keys, keys):
            hit &= have[place] == want
        begins, counts = self.begins[place].astype(np.int64), self.counts[place].astype(np.int64)
        pending = np.flatnonzero(~hit & ~long)
        while len(pending):
            _, sample, inverse = np.unique(h[pending], return_index=True, return_inverse=True)
            new = pending[sample]
            b, n = self._learn([raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            at = place[new]
            for have, want in zip(self.keys, keys):
                have[at] = want[new]
            self.sizes[at], self.begins[at], self.counts[at] = sizes[new], b, n
            same = sizes[pending] == sizes[new][inverse]
            for want in keys:
                same &= want[pending] == want[new][inverse]
            begins[pending[same]], counts[pending[same]] = b[inverse[same]], n[inverse[same]]
            pending = pending[~same]
        away = np.flatnonzero(long)
        if len(away):
            chunks = [raw[s:e] for s, e in zip(starts[away].tolist(), ends[away].tolist())]
            number = {c: i for i, c in enumerate(dict.fromkeys(chunks))}
            b, n = self._learn(list(number))
            index = np.fromiter((number[c] for c in chunks), np.int64, len(chunks))
            begins[away], counts[away] = b[index], n[index]
        return begins, counts


@functools.lru_cache(2)
def byte_encoder(path: str):
    """A byte-level encoder from a rank file, and the bytes of each of its tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


T.CLEAR += [word_encoder.cache_clear, byte_encoder.cache_clear]

RULES = ("start", "majority", "split")
#: A section ends after the blank that follows a full stop, question or exclamation mark, or after a line break.
SECTION_END = re.compile(r"(?<=[.!?])\s+|\n+")


def sections(text: str) -> list[int]:
    """The ends of a text's sections, in code points; together they cover it."""
    ends = [m.end() for m in SECTION_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def attribute(token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, by joining two lists of adjacent intervals.

    token_ends are where tokens end and bounds where sections begin (and the last ends), both
    in bytes, and both cover the text. A token inside one section counts there. One that
    crosses a boundary counts, by rule: ``start``, where its first byte is; ``majority``, where
    most of its bytes are, the earliest of equal ones; ``split``, in each by its share of bytes.
    """
    n = len(bounds) - 1
    token_starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(bounds, token_starts, "right") - 1
    last = np.searchsorted(bounds, token_ends, "left") - 1
    if rule == "start":
        return np.bincount(first, minlength=n)[:n].astype(float)
    inside = first == last
    out = np.bincount(first[inside], minlength=n)[:n].astype(float)
    for i in np.flatnonzero(~inside).tolist():
        a, b = token_starts[i], token_ends[i]
        covered = range(first[i], last[i] + 1)
        shares = np.array([min(b, bounds[s + 1]) - max(a, bounds[s]) for s in covered], float)
        if rule == "majority":
            out[first[i] + int(shares.argmax())] += 1
        else:
            out[first[i] : last[i] + 1] += shares / (b - a)
    return out


def count_tokens(docs: DataFrame, path: str | None = None, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Tokens by field and section of each document, which is encoded once as a whole.

    The document is its fields, each followed by a line break, and then its text. Returns a row
    a document: doc_id, n_tokens, field_tokens (for each of ``fields``), text_tokens (their sum
    over the sections), section_ends (code points in the text) and section_tokens. Counts are
    doubles, as the rule ``split`` gives shares; they add up to n_tokens.

    A null field or text is an empty one; an empty text has no section. A field that does not
    exist is empty too. Repeated rows each get their own row.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    empty = F.lit("")
    columns = [F.coalesce(F.col(c).cast("string"), empty) if c in docs.columns else empty for c in (*fields, text_col)]
    rows = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(f"f{i}") for i, c in enumerate(columns)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    floats = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.enter("tokens")
        encoding, lengths = byte_encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for *heads, text in zip(*(c.to_pylist() for c in batch.columns[1:])):
                whole = "".join(f"{h}\n" for h in heads) + text
                ids = np.frombuffer(encoding.encode_to_numpy(whole), np.uint32) if whole else np.zeros(0, np.uint32)
                ends = np.cumsum(lengths[ids])
                stops = sections(text) if text else []
                sizes = [len(h.encode()) + 1 for h in heads]
                raw = text.encode()
                if len(raw) == len(text):
                    at = np.array(stops, np.int64)
                else:  # from code points to bytes
                    chars = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    at = np.append(chars, len(raw))[stops] if stops else np.zeros(0, np.int64)
                head = np.cumsum([0, *sizes])
                bounds = np.concatenate((head, head[-1] + at)).astype(np.int64)
                got = attribute(ends, bounds, rule) if len(ids) else np.zeros(len(bounds) - 1)
                k = len(sizes)
                out.append((len(ids), got[:k].tolist(), float(got[k:].sum()), stops, got[k:].tolist()))
            n, by_field, by_text, stops, by_section = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(by_field, floats), pa.array(by_text, pa.float64()), pa.array(stops, pa.list_(pa.int32())), pa.array(by_section, floats)],
                names=["doc_id", "n_tokens", "field_tokens", "text_tokens", "section_ends", "section_tokens"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, field_tokens array<double>, text_tokens double, section_ends array<int>, section_tokens array<double>")
