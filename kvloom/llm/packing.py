"""Operator 8: documents packed into sequences with their lexical neighbours.

Documents are encoded once and dealt into shards of bounded size by the ids they have, so that a
shard has documents of one content whatever file they are in: those with the same weighted MinHash,
in which rarer ids count more, come one after the other.
Each shard has an inverted index with BM25 weights, whose document frequencies and mean
length are those of all documents. A window's seed asks the index for unused neighbours,
which fill it in order of score; the one that doesn't fit is cut, and what is left of it
begins the next window as its seed. So all windows of a shard are full but the end, which
becomes sequences of powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm import textops as T
from kvloom.llm.shared import checkpoint
from kvloom.llm.tokens import vocabulary, word_encoder

WINDOW = 2048
END = 1
#: A shard has at most so many documents, and is closed once it has so many ids.
SHARD_DOCS, SHARD_IDS = 1024, 1_000_000
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Postings of ids that more than one in so many documents of a shard have are kept as dense rows.
DENSE = 8
VOCABULARY = 1 << 16
#: Documents counted together for document frequencies.
COUNTED = 64


def encode(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 16-bit, with the end id) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.enter("encode")
        encoder = word_encoder(path)
        for batch in batches:
            parts = T.slices(batch.column(1))
            for a, b in T.groups(parts):
                ids, bounds = encoder.encode(parts[a:b])
                out = [np.append(ids[x:y], np.uint16(END)).tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def draws(idf: np.ndarray) -> np.ndarray:
    """The place of each id in a draw weighted by idf; ids of one document, which no two share, come last."""
    ticket = -np.log(np.random.default_rng(8).random(len(idf))) / np.maximum(idf, 1e-6) ** 2
    df = np.exp(float(idf.max()) - idf) / 2 - 0.5  # an id that no document has is the one of the largest
    ticket[df < 1.5] += 1e9
    out = np.empty(len(idf), np.int32)
    out[np.argsort(ticket)] = np.arange(len(idf), dtype=np.int32)
    return out


def deal(encoded: DataFrame, shared) -> DataFrame:
    """The encoded rows in order of the two ids that come first in the draw; a key of many rows goes to several tasks."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = draws(shared.value[0])
        for batch in batches:
            first, second = [], []
            for part in batch.column(1).to_pylist():
                at = place[np.frombuffer(part, np.uint16)]
                least = at.min()
                first.append(int(least))
                second.append(int(at.min(where=at > least, initial=len(place))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], names=["doc_id", "ids", "k", "l"])

    keyed = encoded.mapInArrow(run, f"doc_id {kind}, ids binary, k int, l int").withColumn("m", F.xxhash64("doc_id", "ids"))
    return keyed.repartitionByRange("k", "l", "m").sortWithinPartitions("k", "l", "m").select("doc_id", "ids")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(VOCABULARY, np.int64)
    n_docs = n_ids = 0
    seen = np.zeros((COUNTED, VOCABULARY), bool)
    for batch in batches:
        parts = T.slices(batch.column(0))
        for a in range(0, len(parts), COUNTED):
            seen[:] = False
            for i, part in enumerate(parts[a : a + COUNTED]):
                ids = np.frombuffer(part, np.uint16)
                seen[i, ids] = True
                n_ids += len(ids)
            total += np.count_nonzero(seen, axis=0)
        n_docs += len(parts)
    terms = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(terms, [-1, -2]), pa.int32()), pa.array(np.append(total[terms], [n_docs, n_ids]), pa.int64())], names=["term", "n"]
    )


def statistics(encoded: DataFrame) -> tuple[np.ndarray, float]:
    """The inverse document frequency of each id, and the mean length, over all documents; at most a row an id comes to the driver."""
    counts = {r.term: r.n for r in encoded.select("ids").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, ids = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(VOCABULARY)
    df[list(counts)] = list(counts.values())
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), ids / max(n, 1)


class Index:
    """An inverted index of a shard: for each id, the documents that have it and its BM25 weight there."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = n = len(docs)
        lengths = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
        keys, tf = np.unique(np.concatenate(docs).astype(np.int32) * np.int32(n) + owner, return_counts=True)  # under 2 ** 16 times SHARD_DOCS
        terms, owners = keys // n, keys % n
        norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        weights = (idf[terms] * tf * (K1 + 1) / (tf + norm[owners])).astype(np.float32)
        order = np.argsort(owners, kind="stable")
        self.doc_terms, self.doc_bounds = terms[order], np.searchsorted(owners[order], np.arange(n + 1))
        counts = np.bincount(terms, minlength=VOCABULARY)
        common = np.flatnonzero(counts * DENSE > n)
        self.row = np.full(VOCABULARY, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n), np.float32)
        at = self.row[terms]
        self.dense[at[at >= 0], owners[at >= 0]] = weights[at >= 0]
        rare = at < 0
        self.owners, self.weights = owners[rare], weights[rare]
        counts[common] = 0
        self.bounds = np.concatenate(([0], np.cumsum(counts)))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of each document for the ids of one."""
        terms = self.doc_terms[self.doc_bounds[doc] : self.doc_bounds[doc + 1]]
        rows = self.row[terms]
        begins, counts = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        after = np.cumsum(counts)
        at = np.arange(after[-1]) + np.repeat(begins - after + counts, counts)
        return np.bincount(self.owners[at], self.weights[at], self.n) + self.dense[rows[rows >= 0]].sum(0)


def order(docs: list[np.ndarray], index: Index, window: int) -> list[int]:
    """The documents in the order in which they fill windows."""
    lengths = [len(d) for d in docs]
    used = np.zeros(len(docs), bool)
    out: list[int] = []
    filled = 0
    fresh = 0
    seed = None
    while len(out) < len(docs):
        if seed is None:  # nothing is left of the last neighbour, or no neighbour has a term in common
            while used[fresh]:
                fresh += 1
            seed = fresh
            used[seed] = True
            out.append(seed)
            filled = (filled + lengths[seed]) % window
            if filled == 0:
                seed = None
                continue
        space = window - filled
        scores = index.scores(seed)
        scores[used] = 0
        seed = None
        while space > 0:
            best = int(scores.argmax())
            if scores[best] <= 0:
                break
            scores[best] = 0
            used[best] = True
            out.append(best)
            filled = (filled + lengths[best]) % window
            if lengths[best] > space:
                seed = best
            space -= lengths[best]
    return out


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_sequence(partition: int, shard: int) -> int:
    """The number of the first sequence of a partition's shard: 26, 17 and 20 bits for partition, shard and sequence."""
    if partition >= 1 << 26 or shard >= 1 << 17:
        raise ValueError(f"partition {partition} or its shard {shard} has no numbers left; use fewer partitions or more of them")
    return ((partition << 17) + shard) << 20


def pack_shard(names: list, docs: list[np.ndarray], index: Index, shard: int, window: int) -> Iterator[tuple]:
    """Pieces of the documents of a shard, whose first sequence has that number: name, start, length, CRC, ids of the document, sequence, offset there, ids."""
    sequence, offset, capacity = shard, 0, window
    left = sum(map(len, docs))
    if left < window:
        capacity = 1 << (left.bit_length() - 1)
    for d in order(docs, index, window):
        start = 0
        while start < len(docs[d]):
            take = min(len(docs[d]) - start, capacity - offset)
            ids = docs[d][start : start + take].astype("<u4").tobytes()
            yield names[d], start, take, zlib.crc32(ids), len(docs[d]), sequence, offset, ids
            start, offset, left = start + take, offset + take, left - take
            if offset == capacity and left:
                sequence, offset = sequence + 1, 0
                capacity = window if left >= window else 1 << (left.bit_length() - 1)


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece; with_ids adds the ids themselves.

    Every id of every row is in exactly one piece. A null or empty text is its end id alone.
    Rows with one doc_id are documents of their own. ``window`` is a power of two. A vocabulary has at most 65,536 ids,
    and a shard at most 2^20 sequences.
    """
    if window & (window - 1):
        raise ValueError("window is a power of two")
    path = path or vocabulary("word_bpe_49k.json")  # of at most VOCABULARY ids, which are kept in 16 bits
    encoded = checkpoint(encode(docs, id_col, text_col, path))
    shared = docs.sparkSession.sparkContext.broadcast(statistics(encoded))  # an entry an id of the vocabulary
    kind = encoded.schema["doc_id"].dataType.simpleString()
    id_type = pa.schema([("x", pa.int64())]).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        T.enter("pack")
        idf, mean = shared.value
        names: list = []
        texts: list[np.ndarray] = []
        partition, now = TaskContext.get().partitionId(), 0
        n_ids = 0

        def flush() -> pa.RecordBatch:
            rows = zip(*pack_shard(names, texts, Index(texts, idf, mean), first_sequence(partition, now), window))
            arrays = [pa.array(x, t) for x, t in zip(rows, [id_type, *[pa.int64()] * 6, pa.binary()])]
            return pa.RecordBatch.from_arrays(arrays[: 7 + with_ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids])

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(texts) == SHARD_DOCS or n_ids > SHARD_IDS:
                    yield flush()
                    names, texts, now, n_ids = [], [], now + 1, 0
                names.append(name)
                texts.append(np.frombuffer(ids, np.uint16))
                n_ids += len(texts[-1])
        if texts:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(encoded.schema["doc_id"].dataType)
    return deal(encoded, shared).mapInArrow(run, f"doc_id {kind}, {_PIECES}" + ", ids binary" * with_ids)
