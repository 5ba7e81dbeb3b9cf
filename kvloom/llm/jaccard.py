"""Operator 7: documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

Equal shingle sets are one node. Nodes that agree in a band of MinHash values share a
bucket; the pairs of a bucket compare their values a few at a time, and a pair is dropped
when the posterior probability that it reaches the threshold falls under a tolerance.
What is left connects nodes into groups, inside which every pair is verified on the sets.

Pairs are never rows. Buckets and groups that are too large for a task are dealt as blocks of
pairs, and a block tells how many links each of its nodes has, and a forest of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm import decontaminate
from kvloom.llm import textops as T
from kvloom.llm.shared import checkpoint, components, fresh, only_marked

WORDS, THRESHOLD = 5, 0.8
#: MinHash values of a byte each, in bands of so many: a pair at the threshold shares a band but for 5 in a million.
BANDS, ROWS = 40, 6
VALUES = BANDS * ROWS
#: Values compared between two looks at the posterior, and the probability under which a pair is dropped.
STEP, TOLERANCE = 24, 1e-6
#: Nodes of a block's side in buckets and in groups, and the size up to which pairs are listed.
CHUNK, VERIFIED, SMALL = 1024, 256, 24

_rng = np.random.Generator(np.random.PCG64(77))
FACTORS = _rng.integers(1, 1 << 62, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(parts: list, words: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles; of a text with fewer words, the one of all its words."""
    x = decontaminate.Texts(parts)
    starts, ends, first = x.words(decontaminate.SEPARATORS)
    h = x.hashes(starts, ends)
    grams = T.windows(h, words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(T.windows(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, VALUES) bytes: of each hash function's smallest value, eight bits. Sets are not empty."""
    lengths = np.array([len(s) for s in sets])
    begins = np.cumsum(lengths) - lengths
    flat = np.concatenate(sets)
    out = np.empty((len(sets), VALUES), np.uint8)
    for i, factor in enumerate(FACTORS):
        least = np.minimum.reduceat(flat * factor, begins)
        out[:, i] = T.mix(least) >> np.uint64(56)
    return out


def needed(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones): with fewer, the posterior probability of the threshold is under the tolerance.

    With a uniform prior, the probability that two values are equal is after m of n equal ones
    Beta(m + 1, n - m + 1), and it is over t with the probability of at most m successes in n + 1 trials.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
            if total >= tolerance:
                break
        out.append((n, m))
    return out


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are not dropped."""
    equal = np.zeros(len(i), np.int16)
    at = 0
    for n, m in least:
        equal = equal + np.count_nonzero(sig[i, at:n] == sig[j, at:n], axis=1).astype(np.int16)
        keep = equal >= m
        i, j, equal, at = i[keep], j[keep], equal[keep], n
        if not len(i):
            break
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of n numbers is connected with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _fixed(column, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    return np.frombuffer(b"".join(T.slices(column)), np.uint8).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of rows that are sorted by the first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in batch.columns[:keys]:
            if pa.types.is_binary(c.type):
                rows = _fixed(c, 16)
                new[1:] |= (rows[1:] != rows[:-1]).any(1)
            else:
                values = c.to_numpy(zero_copy_only=False)
                new[1:] |= values[1:] != values[:-1]
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield pa.Table.from_batches([*held, batch[:last]])
            held = []
        held.append(batch[last:])
    if held:
        yield pa.Table.from_batches(held)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.enter("jaccard")
        for batch in batches:
            parts = T.slices(batch.column(1))
            for a, b in T.groups(parts):
                sets = shingles(parts[a:b], words)
                full = [k for k, s in enumerate(sets) if len(s)]
                nodes = np.zeros((len(sets), 16), np.uint8)
                sig = np.zeros((len(sets), VALUES), np.uint8)
                if full:
                    sig[full] = signature([sets[k] for k in full])
                    nodes[full] = np.concatenate([node_of(sets[k]) for k in full]).reshape(-1, 16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], _binary(nodes), pa.array([len(s) for s in sets], pa.int32()), _binary(sig)], names=["doc", "node", "n", "sig"]
                )

    return run


def node_of(one: np.ndarray) -> np.ndarray:
    """128 bits that name a set, as bytes."""
    place = np.arange(len(one), dtype=np.uint64)
    a = T.mix(one + T.mix(place)).sum(dtype=np.uint64)
    b = T.mix(one ^ T.mix(place + np.uint64(1 << 40))).sum(dtype=np.uint64)
    return T.mix(np.array([a, b ^ np.uint64(len(one))])).view(np.uint8)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = (np.uint64(1) << (np.arange(ROWS, dtype=np.uint64) * np.uint64(8)))[None, :]
    for batch in batches:
        for a in range(0, batch.num_rows, 5000):
            part = batch[a : a + 5000]
            nodes, sig = _fixed(part.column(0), 16), _fixed(part.column(1), VALUES)
            for band in range(BANDS):
                value = (sig[:, band * ROWS : (band + 1) * ROWS].astype(np.uint64) * weights).sum(1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(value | np.uint64(band << 48))), _binary(nodes)], names=["bucket", "node"])


def _compare(threshold: float):
    least = needed(threshold)

    def pairs_of(x: np.ndarray, i: int, j: int, chunk: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one large block."""
        left, right = x[chunk[x] == i], x[chunk[x] == j]
        found = []
        n, m = least[0]
        for a in range(0, len(left), 256):
            rows = sig[left[a : a + 256]]
            equal = np.zeros((len(rows), len(right)), np.uint8)
            for v in range(n):
                equal += rows[:, v][:, None] == sig[right, v][None, :]
            r, c = np.nonzero(equal >= m)
            p, q = left[a + r], right[c]
            keep = p < q if i == j else slice(None)
            found.append(prune(sig, p[keep], q[keep], least))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            table = table.combine_chunks()
            bucket, i, j, chunk = (table.column(k).to_numpy() for k in range(4))
            nodes, sig = _fixed(table.column(4), 16), _fixed(table.column(5), VALUES)
            begins = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            sizes = np.diff(np.append(begins, len(bucket)))
            one, other = [], []
            for size in np.unique(sizes[sizes > 1]).tolist():
                starts = begins[sizes == size]
                if size <= SMALL:
                    p, q = np.triu_indices(size, 1)
                    cross = (i[starts] == j[starts])[:, None] | (chunk[starts[:, None] + p] != chunk[starts[:, None] + q])
                    a, b = (starts[:, None] + p)[cross], (starts[:, None] + q)[cross]
                    for k in range(0, len(a), 50_000):
                        got = prune(sig, a[k : k + 50_000], b[k : k + 50_000], least)
                        one.append(got[0])
                        other.append(got[1])
                else:
                    for s in starts.tolist():
                        got = pairs_of(np.arange(s, s + size), i[s], j[s], chunk, sig)
                        one.append(got[0])
                        other.append(got[1])
            if one:
                root = _roots(len(nodes), np.concatenate(one), np.concatenate(other))
                at = np.flatnonzero(root != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays([_binary(nodes[at]), _binary(nodes[root[at]])], names=["a", "b"])

    return run


def _blocks(df: DataFrame, size: str, chunk: int, key: str, *columns: str) -> DataFrame:
    """Rows for each block of pairs: (key, i, j, c) and the columns, where c is the row's own chunk of its key's."""
    k = F.ceil(F.col(size) / chunk).cast("int")
    df = df.withColumn("k", k).withColumn("c", F.pmod(F.xxhash64("node", F.lit(5)), F.col("k")).cast("int"))
    df = df.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return df.select(key, F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", *columns)


def _listed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = T.slices(batch.column(0))
            for a, b in T.groups(parts):
                sets = [s for s in shingles(parts[a:b], words) if len(s)]
                if sets:
                    nodes = np.concatenate([node_of(s) for s in sets]).reshape(-1, 16)
                    yield pa.RecordBatch.from_arrays([_binary(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets."""
    both = left + right
    lengths = [len(s) for s in both]
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), lengths)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = column[code[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width = 4096
    total = int(shared.sum())
    for a in range(0, total, width):
        x, y = np.searchsorted(code, [a, a + width])
        dense = np.zeros((len(both), min(width, total - a)), np.float32)
        dense[owner[x:y], code[x:y] - a] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out.astype(np.int64)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            table = table.combine_chunks()
            group = _fixed(table.column(0), 16)
            i, j, chunk, mult = (table.column(k).to_numpy() for k in (1, 2, 3, 5))
            nodes = _fixed(table.column(4), 16)
            sets = [np.frombuffer(s, np.uint64) for s in T.slices(table.column(6))]
            new = (group[1:] != group[:-1]).any(1) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            begins = np.concatenate(([0], np.flatnonzero(new) + 1, [len(nodes)]))
            links = np.zeros(len(nodes), np.int64)
            one, other = [], []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                at = np.arange(a, b)
                left, right = at[chunk[at] == i[a]], at[chunk[at] == j[a]]
                if not len(left) or not len(right):
                    continue
                size_l, size_r = (np.array([len(sets[k]) for k in side]) for side in (left, right))
                inter = overlaps([sets[k] for k in left], [sets[k] for k in right])
                union = size_l[:, None] + size_r[None, :] - inter
                linked = inter >= threshold * union - 1e-9
                if i[a] == j[a]:
                    np.fill_diagonal(linked, False)
                else:
                    links[right] += linked.T @ mult[left]
                links[left] += linked @ mult[right]
                p, q = np.nonzero(linked)
                one.append(left[p])
                other.append(right[q])
            root = _roots(len(nodes), np.concatenate(one), np.concatenate(other)) if one else np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([_binary(nodes), pa.array(links), _binary(nodes[root])], names=["node", "links", "parent"])

    return run


def similar(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, node (128 bits that name its shingle set), n (shingles), class_id and n_links of each row.

    Documents are in one class if a chain of links connects them; class_id is the smallest id
    there. n_links counts the other rows that are linked to the row itself. Words are runs of letters and
    digits with A-Z in lower case. A text of fewer words than a shingle has one, of all its words. A text
    without words, or null, is linked with nothing and a class of its own. Null ids count, but
    name a class only if it has no other.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = checkpoint(base.mapInArrow(_sets(words), "doc long, node binary, n int, sig binary"))
    reps = checkpoint(rows.where("n > 0").groupBy("node").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("sig").alias("sig")))
    # buckets of several nodes, and their pairs in blocks
    bands = reps.select("node", "sig").mapInArrow(_bands, "bucket long, node binary")
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    several = bands.join(sizes, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "m")).alias("own"))
    several = several.join(reps.select("node", "sig"), "node").select("node", "sig", F.explode("own").alias("own")).select("node", "sig", "own.bucket", "own.m")
    blocks = _blocks(several, "m", CHUNK, "bucket", "node", "sig").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    near = blocks.mapInArrow(_compare(threshold), "a binary, b binary").distinct()
    groups = checkpoint(components(near))
    # every pair of a group, on the sets themselves
    counted = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    members = groups.join(counted, "root").join(reps.select("node", "rep", "mult"), "node")
    texts = only_marked(base, "doc", members.select(F.col("rep").alias("id"))).select("text").mapInArrow(_listed(words), "node binary, set binary")
    texts = texts.join(groups.select("node"), "node", "left_semi").dropDuplicates(["node"])
    blocks = _blocks(members.join(texts, "node"), "m", VERIFIED, "root", "node", "mult", "set").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    verified = checkpoint(blocks.mapInArrow(_verify(threshold), "node binary, links long, parent binary"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    classes = classes.join(reps.select("node", "rep"), "node")
    classes = classes.join(classes.groupBy("root").agg(F.min("rep").alias("class")), "root").select("node", "class")
    found = verified.groupBy("node").agg(F.sum("links").alias("links")).join(classes, "node", "left")
    found = reps.select("node", "rep", "mult").join(found, "node", "left").select("node", F.coalesce("class", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    whole = rows.select("doc", "node", "n").join(found, "node", "left")
    empty = F.col("n") == 0
    return whole.select("doc", "node", "n", F.when(empty, F.col("doc")).otherwise(F.col("class")).alias("class_id"), F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links and n_shingles of each row; see ``similar``."""
    return similar(docs, **options).select(F.col("doc").alias("doc_id"), "class_id", "n_links", F.col("n").cast("long").alias("n_shingles"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class: the one with its smallest id, and of several with that id the one whose set's name is smallest.

    Columns stay as they are. Documents without words all stay, as they are linked with nothing.
    """
    rows = checkpoint(similar(docs, id_col=id_col, text_col=text_col, **options))
    # classes by id and set; a null id stands for itself
    key = F.coalesce("class_id", F.lit(-(1 << 63)))
    chosen = rows.where("n > 0").groupBy(key.alias("class"), F.col("class_id").isNull().alias("none"), "node").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"))
    chosen = chosen.groupBy("class", "none").agg(F.min(F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("order"), F.col("node"), F.col("doc"))).alias("first"))
    chosen = checkpoint(chosen.select("first.node", "first.doc"))
    repeated = rows.join(chosen, (rows.node == chosen.node) & rows.doc.eqNullSafe(chosen.doc), "left_semi").groupBy("node", "doc").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    names = docs.columns
    at = names.index(text_col)
    own, pick_node, pick_doc = fresh(docs, "__node", "__chosen", "__doc")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = T.slices(batch.column(at))
            nodes = np.zeros((len(parts), 16), np.uint8)
            for a, b in T.groups(parts):
                for k, s in enumerate(shingles(parts[a:b], options.get("words", WORDS))):
                    if len(s):
                        nodes[a + k] = node_of(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(nodes)], names=[*batch.schema.names, own])

    whole = docs.mapInArrow(named, docs.select("*", F.lit(b"").alias(own)).schema)
    wordless = F.col(own) == F.lit(bytes(16))
    pick = chosen.select(F.col("node").alias(pick_node), F.col("doc").alias(pick_doc))
    kept = whole.join(pick, (F.col(own) == F.col(pick_node)) & F.col(id_col).cast("long").eqNullSafe(F.col(pick_doc)), "left").where(wordless | F.col(pick_node).isNotNull())
    if not repeated.isEmpty():
        # equal rows of a chosen document: one stays
        kept = kept.where(wordless).unionByName(kept.where(~wordless).dropDuplicates([id_col, own]))
    return kept.select(*(F.col(f"`{c}`") for c in names))
