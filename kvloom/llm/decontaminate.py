"""Operator 6: benchmark passages in training documents, by a generalised suffix automaton.

The automaton holds the words of all benchmark items. A document's words stream through
it, the longest match that ends at each word is tracked, and every word inside a match
that holds a whole window is hit. Documents are first narrowed to runs of words whose
neighbouring pairs all occur in the benchmark: a match of L words is such a run, so
nothing is lost, and only those runs are walked word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm import textops as T
from kvloom.llm.shared import checkpoint, fresh

WINDOW = 10
#: Bytes of benchmark text in one automaton; a larger benchmark takes several, one at a time in a pass each.
SHARD_BYTES = 1 << 20

#: Bytes that separate words once A-Z is lower case: ASCII but digits and letters.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BITS = 22


class Texts(T.Texts):
    def __init__(self, parts: list):
        super().__init__(parts)
        self.data = LOWER[self.data]


class Automaton:
    """A generalised suffix automaton over words, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(codes) for _, codes in coded)]) if coded else window
        # items by state: a state is marked with each item one of whose prefixes ends in its subtree
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, codes in coded:
            at = 0
            for c in codes:
                at = self.step[at][c]
                if len(codes) >= window:
                    up = at
                    while up > 0 and self.length[up] >= window and name not in self.items.setdefault(up, set()):
                        self.items[up].add(name)
                        up = self.link[up]
            if len(codes) < window:
                self.short.setdefault(at, []).append((len(codes), name))

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.step)
        self.step.append(dict(self.step[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.step)
        self.step.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def walk(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges of the words, merged, and the items whose windows occur."""
        step, link, length, window = self.step, self.link, self.length, self.window
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        at = matched = 0
        for i, word in enumerate(words):
            c = self.ids.get(word, -1)
            while at and c not in step[at]:
                at = link[at]
                matched = length[at]
            if c not in step[at]:
                continue
            at = step[at][c]
            matched += 1
            long = 0
            if matched >= window:
                long = window
                up = at
                while length[link[up]] >= window:
                    up = link[up]
                found |= self.items.get(up, set())
            if self.short:
                up = at
                while up > 0:
                    for n, name in self.short.get(up, ()):
                        if n <= matched:
                            found.add(name)
                            long = max(long, n)
                    up = link[up]
            if long:
                begin = i + 1 - long
                while hits and hits[-1][1] >= begin:
                    begin = min(begin, hits.pop()[0])
                hits.append((begin, i + 1))
        return hits, found


class Filter:
    """Which words, and which pairs of neighbours, occur in the items: bitmaps by hash, so never too few."""

    def __init__(self, items: list[list[bytes]], shortest: int):
        self.shortest = shortest
        self.map = np.zeros(1 << BITS, bool)
        for words in items:
            if words:
                x = T.Texts([b" ".join(words)])
                starts, ends, _ = x.words(SEPARATORS)
                h = x.hashes(starts, ends)
                self.map[self._slot(h if shortest == 1 else T.windows(h, 2))] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    def runs(self, x: Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, first word, end) of the runs that can hold a match."""
        h = x.hashes(starts, ends)
        pair = self.shortest > 1
        known = self.map[self._slot(T.windows(h, 2) if pair else h)]
        if pair and len(known):
            inner = first[1:-1]
            known[inner[(inner > 0) & (inner <= len(known))] - 1] = False  # pairs across documents
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).view(np.int8)))
        begins, stops = edges[0::2], edges[1::2] + pair
        long = stops - begins >= self.shortest
        begins, stops = begins[long], stops[long]
        if not pair:  # cut at documents
            return [(d, max(a, first[d]), min(b, first[d + 1])) for a, b in zip(begins, stops) for d in range(np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b)) if first[d + 1] > first[d]]
        return list(zip((np.searchsorted(first, begins, "right") - 1).tolist(), begins.tolist(), stops.tolist()))


def item_words(text: str) -> list[bytes]:
    x = Texts([text.encode()])
    starts, ends, _ = x.words(SEPARATORS)
    data = x.data.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in bounded parts; each part is what the driver holds at once."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // SHARD_BYTES))
    for i in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
        yield [(r.id, item_words(r.text)) for r in own.toLocalIterator()]


def _scanner(broadcast, text_at: int, hits_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.enter("decontaminate")
        automaton, keep = broadcast.value
        ranges_type, items_type = pa.list_(pa.int32()), pa.list_(pa.string())
        for batch in batches:
            parts = T.slices(batch.column(text_at))
            counts, ranges, items = [], [], []
            for a, b in T.groups(parts):
                x = Texts(parts[a:b])
                starts, ends, first = x.words(SEPARATORS)
                counts += np.diff(first).tolist()
                own_ranges = [[] for _ in range(a, b)]
                own_items: list[set[str]] = [set() for _ in range(a, b)]
                data = None
                for d, begin, end in keep.runs(x, starts, ends, first):
                    data = x.data.tobytes() if data is None else data
                    hits, found = automaton.walk([data[s:e] for s, e in zip(starts[begin:end].tolist(), ends[begin:end].tolist())])
                    shift = begin - first[d]
                    for s, e in hits:
                        own_ranges[d] += [s + shift, e + shift]
                    own_items[d] |= found
                ranges += own_ranges
                items += [sorted(f) for f in own_items]
            before_r, before_i = batch.column(hits_at).to_pylist(), batch.column(hits_at + 1).to_pylist()
            ranges = [_merge((old or []) + new) for old, new in zip(before_r, ranges)]
            items = [sorted({*(old or []), *new}) for old, new in zip(before_i, items)]
            columns = list(batch.columns)
            columns[hits_at : hits_at + 3] = [pa.array(ranges, ranges_type), pa.array(items, items_type), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _merge(flat: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(flat[0::2], flat[1::2])):
        if out and out[-1] >= a:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs with three more columns: hit words (starts and ends in turn), items (sorted ids) and the number of words.

    They are called __ranges, __items and __words, with more underscores if docs has such columns.

    One scan for each part of the benchmark; between scans the rows go through a checkpoint.
    """
    spark = docs.sparkSession
    names = fresh(docs, "__ranges", "__items", "__words")
    none = (F.array().cast("array<int>"), F.array().cast("array<string>"), F.lit(0).cast("long"))
    df = docs.select("*", *[value.alias(name) for value, name in zip(none, names)])
    text_at, hits_at = docs.columns.index(text_col), len(docs.columns)
    for i, items in enumerate(shards(benchmark, item_col, item_text)):
        automaton = Automaton(items, window)
        shared = spark.sparkContext.broadcast((automaton, Filter([w for _, w in items], automaton.shortest)))
        df = (checkpoint(df) if i else df).mapInArrow(_scanner(shared, text_at, hits_at), df.schema)
    return df


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row.

    A null text has no words. A null item id is an empty one; items with one id count once.
    An empty benchmark hits nothing. Repeated rows each get their own row.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hit = [sum(r[1::2]) - sum(r[0::2]) for r in ranges]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(sha, pa.string()), pa.array([n > 0 for n in hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    found = find_hits(rows, benchmark, "text", window)
    # the texts stay in the scanning worker
    kept = found.select("doc_id", F.lit(None).cast("string").alias("text"), "__ranges", "__items", "__words")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """The documents without the benchmark's passages: hit words go, and so do documents of which more than max_coverage is hit.

    Columns stay as they are; n_chars, if there, follows the text. Documents without a hit keep
    their bytes, and so do null and empty ones.
    """
    found = find_hits(docs, benchmark, text_col, window)
    text_at, hits_at = docs.columns.index(text_col), len(docs.columns)
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, words = batch.column(hits_at).to_pylist(), batch.column(hits_at + 2).to_pylist()
            keep = [not r or sum(r[1::2]) - sum(r[0::2]) <= max_coverage * n for r, n in zip(ranges, words)]
            batch = batch.filter(pa.array(keep, pa.bool_()))
            ranges = [r for r, k in zip(ranges, keep) if k]
            columns = list(batch.columns[:hits_at])
            if any(ranges):
                texts = columns[text_at].to_pylist()
                for i, r in enumerate(ranges):
                    if r:
                        texts[i] = _without(texts[i], r)
                columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
                if count_at is not None:
                    counts = columns[count_at].to_pylist()
                    counts = [len(t) if r else n for t, r, n in zip(texts, ranges, counts)]
                    columns[count_at] = pa.array(counts, batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:hits_at])

    return found.mapInArrow(cut, docs.schema)


def _without(text: str, ranges: list[int]) -> str:
    raw = text.encode()
    starts, ends, _ = Texts([raw]).words(SEPARATORS)
    out, at = [], 0
    for a, b in zip(ranges[0::2], ranges[1::2]):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    out.append(raw[at:])
    return b"".join(out).decode()
