"""Operator 5: passages that repeat across documents, by level-wise doubling.

A window is some consecutive words. Levels have lengths of half the window (rounded up),
the half of that and so on, ascending: each at most twice the one before. At a level a
window is represented by the smallest hash among its grams of that length, so equal windows
have equal representatives and neighbours share one. Representatives that occur in one
document only can't belong to a repeated window; windows whose representative is in several
documents are extended to the next length, until the windows themselves are compared or
none is left. Exact copies of a document with a smaller id are set aside at the start.

At each level the hashes are dealt by value and sorted, and read as a stream. Within a
batch of documents what repeats is known before it is dealt, and only one row of it
goes to the hash's task, so that a passage of a third of all documents is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm import textops as T

WINDOW = 13
#: The shortest length of a level.
LEAST = 4
#: Bytes of text among which repeats are found before anything is dealt.
BATCH_BYTES = 4 << 20

#: A row of a stream has a run: none if it is alone in its batch or stands for several documents of it; so many windows are known already.
ALONE, SEVERAL, KNOWN = 0, -1, 1

_KEYS = "doc long, crc int"


def levels(window: int, least: int = LEAST) -> list[int]:
    """Ascending lengths up to the window, each at most twice the one before."""
    out = [window]
    while -(-out[0] // 2) >= least and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values, by doubling."""
    have, out = 1, values
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


class _Words:
    """Word hashes of some documents, and which windows lie in one."""

    def __init__(self, parts: list, window: int, which: int = 0):
        self.text = T.Texts(parts)
        self.starts, self.ends, self.first = self.text.words(T.BLANK)
        self.window = window
        self.own = T.owners(self.first)
        n = max(len(self.own) - window + 1, 0)
        self.whole = self.own[:n] == self.own[window - 1 : window - 1 + n] if n else np.zeros(0, bool)
        self.hash = self.text.hashes(self.starts, self.ends, which=which)

    def representatives(self, length: int) -> np.ndarray:
        return sliding_min(T.windows(self.hash, length), self.window - length + 1)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)


def _judge(g: np.ndarray, g2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts rows by hash and document: the order, whether a row begins a hash, and whether it is of the hash's smallest document."""
    order = np.lexsort((doc, g2, g))
    g, g2, doc = g[order], g2[order], doc[order]
    begins = np.ones(len(g), bool)
    begins[1:] = (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])
    least = doc[begins][np.cumsum(begins) - 1]
    return order, begins, doc == least


def _emit(length: int, window: int, candidates: bool):
    """Rows (g, g2, doc, crc, pos, run) of the windows that may repeat; pos is a window's place at the last level.

    The input is doc, crc, text and, if ``candidates``, the representatives at the length before that are in several documents.
    """
    last = length == window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, crcs = _keys(batch)
            parts = T.slices(batch.column(2))
            for a, b in T.groups(parts, BATCH_BYTES):
                words = _Words(parts[a:b], window)
                live = words.whole
                if candidates:
                    live = live & _survive(words, batch.column(3)[a:b], -(-length // 2))
                at = np.flatnonzero(live)
                g = words.representatives(length)[at]
                own = words.own[at]
                if last:
                    g2 = (T.windows(words.text.hashes(words.starts, words.ends, which=1), window, 1)[at] >> np.uint64(32)).astype(np.uint32)
                    place = at - words.first[own]
                else:
                    # neighbours share a representative; a document's own are told once
                    new = np.ones(len(g), bool)
                    new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
                    order = np.lexsort((g[new], own[new]))
                    g, own = g[new][order], own[new][order]
                    new = np.ones(len(g), bool)
                    new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
                    g, own = g[new], own[new]
                    g2, place = np.zeros(len(g), np.uint32), np.zeros(len(g), np.int64)
                if not len(g):
                    continue
                doc, crc = docs[a:b][own], crcs[a:b][own]
                order, begins, smallest = _judge(g, g2, doc)
                g, g2, doc, crc, place, own = (x[order] for x in (g, g2, doc, crc, place, own))
                group = np.cumsum(begins) - 1
                if last:  # a larger id than another's here: known
                    state = np.where(smallest, ALONE, KNOWN)
                else:  # the first of several stands for them
                    several = ~np.logical_and.reduceat(smallest, np.flatnonzero(begins))[group]
                    state = np.where(several, np.where(begins, SEVERAL, KNOWN), ALONE)
                yield from _rows(g, g2, doc, crc, place, state, own, last)

    return run


def _survive(words: _Words, lists: pa.Array, before: int) -> np.ndarray:
    """Whether a window's representative at the length before is one of its document's survivors."""
    sizes = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([len(x) if x.is_valid else 0 for x in lists])
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    rep = words.representatives(before)
    # a document's number salts the hash, so one sorted list serves all
    salt = T.mix(np.arange(len(sizes), dtype=np.uint64) + np.uint64(1))
    known = np.sort(values ^ np.repeat(salt, sizes))
    if not len(known):
        return np.zeros(len(words.whole), bool)
    want = rep ^ salt[words.own[: len(rep)]]
    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
    return known[at] == want


def _rows(g, g2, doc, crc, place, run, own, last: bool) -> Iterator[pa.RecordBatch]:
    run = run.astype(np.int32)
    keep = np.ones(len(g), bool)
    if last:  # known windows that follow one another are one row
        known = np.flatnonzero(run == KNOWN)
        known = known[np.lexsort((place[known], own[known]))]
        if len(known):
            begins = np.ones(len(known), bool)
            begins[1:] = (own[known][1:] != own[known][:-1]) | (place[known][1:] != place[known][:-1] + 1)
            firsts = np.flatnonzero(begins)
            keep[known[~begins]] = False
            run[known[firsts]] = np.diff(np.append(firsts, len(known)))
            g2 = g2.copy()
            g2[known] = 0
    columns = [T.signed(g), g2.view(np.int32), doc, crc, place.astype(np.int32), run]
    names = ["g", "g2", "doc", "crc", "pos", "run"]
    for a in range(0, int(keep.sum()), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[keep][a : a + 200_000]) for c in columns], names=names)


_ROW = "g long, g2 int, doc long, crc int, pos int, run int"


def _stream(last: bool):
    """Of rows sorted by (g, g2, doc): known ones, and those of a hash in several documents; at the last level, all but its smallest document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        now = None  # of the hash that the batch before ended in: itself, its smallest document, whether it is in several
        for batch in batches:
            rows = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns)}
            known = rows["run"] >= KNOWN
            if known.any():
                yield _found({n: c[known] for n, c in rows.items()}, last)
                rows = {n: c[~known] for n, c in rows.items()}
            if held is not None:
                rows = {n: np.concatenate((held[n], c)) for n, c in rows.items()}
                held = None
            g, g2, doc = rows["g"], rows["g2"], rows["doc"]
            if not len(g):
                continue
            begins = np.ones(len(g), bool)
            begins[1:] = (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])
            if now is not None and (g[0], g2[0]) == now[0]:
                begins[0] = False
            group = np.cumsum(begins)
            heads = np.flatnonzero(begins)
            least = np.concatenate(([now[1] if now else 0], doc[heads]))[group]
            many = np.zeros(len(heads) + 1, bool)
            many[0] = bool(now and now[2])
            np.logical_or.at(many, group, (doc != least) | (rows["run"] == SEVERAL))
            out = (doc != least) if last else many[group]
            end = (g[-1], g2[-1])
            if not last and not many[group[-1]]:
                # one document so far: its rows wait for the next batch
                tail = group == group[-1]
                held = {n: c[tail] for n, c in rows.items()}
                now = None
                out &= ~tail
            else:
                now = (end, least[-1], many[group[-1]])
            if out.any():
                yield _found({n: c[out] for n, c in rows.items()}, last)

    return run


def _found(rows: dict[str, np.ndarray], last: bool) -> pa.RecordBatch:
    if last:
        return pa.RecordBatch.from_arrays([pa.array(rows["doc"]), pa.array(rows["crc"]), pa.array(rows["pos"]), pa.array(np.maximum(rows["run"], 1))], names=["doc", "crc", "pos", "run"])
    return pa.RecordBatch.from_arrays([pa.array(rows["doc"]), pa.array(rows["crc"]), pa.array(rows["g"])], names=["doc", "crc", "g"])


def _finish(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            runs = batch.column(4).to_pylist()
            for part, copy, own in zip(T.slices(batch.column(2)), batch.column(3).to_pylist(), runs):
                words = bytes(part).split()  # the same six blanks
                n = len(words)
                if copy and n >= window:
                    words = []
                elif own:
                    gone = np.zeros(n + 1, np.int32)
                    at = np.array([r["pos"] for r in own])
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + np.array([r["run"] for r in own]) + window - 1, -1)
                    words = [w for w, k in zip(words, np.cumsum(gone[:-1]).tolist()) if not k]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc", "crc", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by a space) of each row; with digest, kept_sha256 in its place.

    Words are what ASCII blanks part, unchanged. A word goes if a window covers it whose words also
    stand, in that order, in a document with a smaller id. A null text has no words. A null id is
    larger than all others, and an id of 2^63 - 1 is taken for one. Rows of one id are no sources for each other; equal rows get equal results.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    # a CRC tells rows of one id apart; with an id a row, as ever, there is nothing to tell
    repeated = not docs.groupBy(doc.alias("doc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    crc = (F.crc32(F.encode(text, "UTF-8")) - (1 << 31)).cast("int") if repeated else F.lit(0)
    base = docs.select(doc.alias("doc"), crc.alias("crc"), text.alias("text"))
    keys = ["doc", "crc"]
    # exact copies of a text with a smaller id
    texts = base.select("doc", "crc", F.sha2("text", 256).alias("sha"))
    least = texts.groupBy("sha").agg(F.min("doc").alias("least"))
    copies = texts.join(least, "sha").where("doc > least").select(*keys, F.lit(True).alias("copy")).distinct()
    marked = base.join(copies, keys, "left")
    fresh = marked.where("copy is null").drop("copy")
    survivors = None
    for length in levels(window):
        last = length == window
        here = fresh if survivors is None else fresh.join(survivors, keys)
        rows = here.mapInArrow(_emit(length, window, survivors is not None), _ROW)
        dealt = F.when(F.col("run") >= KNOWN, F.xxhash64("doc", "g")).otherwise(F.col("g"))
        rows = rows.repartition(dealt).sortWithinPartitions("g", "g2", "doc")
        found = rows.mapInArrow(_stream(last), f"{_KEYS}, pos int, run int" if last else f"{_KEYS}, g long")
        if last:
            survivors = found.groupBy(*keys).agg(F.collect_list(F.struct("pos", "run")).alias("runs"))
        else:
            survivors = found.groupBy(*keys).agg(F.collect_list("g").alias("gs"))
    out = marked.join(survivors, keys, "left").select(*keys, "text", "copy", "runs").mapInArrow(_finish(window), f"{_KEYS}, n_words long, n_removed long, kept string")
    ids = F.when(F.col("doc") != (1 << 63) - 1, F.col("doc")).alias("doc_id")
    return out.select(ids, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256") if digest else F.col("kept"))
