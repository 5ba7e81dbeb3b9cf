"""Operator 9: secrets by fixed patterns and by a battery of randomness tests.

Each long run of encoding characters is a candidate. Its encoding is the smallest
alphabet that holds it. Three tests of the hypothesis that its symbols are random
give p-values: chi-squared for uniformity, runs about the middle of the alphabet,
and serial correlation. A weighted Benjamini-Hochberg procedure over the candidates
of all documents, by encoding and with weights that follow length, rejects the
ones that are not random; what is left and is long enough to be told is a secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed patterns: a match counts if its part is long enough. Upper and lower case are ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Encodings from the narrowest alphabet to the widest, and the fewest symbols the battery can tell from words.
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("digits", DIGITS, 64),
    ("hex", HEX_LOWER, 24),
    ("hex", HEX_UPPER, 24),
    ("lower", LOWER, 64),
    ("upper", UPPER, 40),
    ("base32", UPPER + "234567", 24),
    ("base36", LOWER + DIGITS, 24),
    ("base36", UPPER + DIGITS, 24),
    ("base62", UPPER + LOWER + DIGITS, 24),
    ("base64", UPPER + LOWER + DIGITS + "+/", 24),
    ("base64url", UPPER + LOWER + DIGITS + "-_", 24),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{24,}")
#: Parts of a run that has characters of both base64 alphabets.
WITHOUT_MINUS, WITHOUT_PLUS = re.compile(r"[A-Za-z0-9+/]{24,}"), re.compile(r"[A-Za-z0-9_-]{24,}")
#: False-discovery rate at which a candidate is called not random.
RATE = 0.05
#: Bins of -log10(p) for the cut: 0 to 30 in steps of 1/20.
BINS, PER_DECADE = 600, 20
TYPICAL_LENGTH = 32.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping for each kind, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a maximal run is matched whole, so the length can stand in the pattern
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(symbols: np.ndarray, size: int) -> float:
    """The p-value of the hypothesis that the symbols (0 to size - 1) are random: three tests, Bonferroni."""
    n = len(symbols)
    counts = np.bincount(symbols, minlength=size)
    chi = float((counts.astype(float) ** 2).sum() * size / n - n)
    df = size - 1
    # Wilson-Hilferty, with the variance of the finite sample
    spread = math.sqrt(2 / (9 * df) * (n - 1) / n)
    p_chi = _upper_normal(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / spread)
    high = symbols >= size / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n1 == 0 or n0 == 0:
        p_runs = 2.0**-n
    else:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n1 * n0 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = 2 * _upper_normal(abs(runs - mean) / math.sqrt(var))
    x = symbols - symbols.mean()
    total = float((x * x).sum())
    serial = float((x[1:] * x[:-1]).sum()) / total if total else 1.0
    p_serial = 2 * _upper_normal(abs(serial + 1 / n) * math.sqrt(n))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


_CODES = [(name, frozenset(alphabet), {c: i for i, c in enumerate(alphabet)}, least) for name, alphabet, least in ENCODINGS]


def infer(body: str) -> tuple[str, np.ndarray, int] | None:
    """The narrowest encoding that holds the body, its symbols and the alphabet's size; None if too short."""
    used = set(body)
    for name, alphabet, codes, least in _CODES:
        if used <= alphabet:
            if len(body) < least:
                return None
            return name, np.array([codes[c] for c in body]), len(codes)
    return None


def parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a run: all of it if one alphabet holds it, else the maximal parts that one of the two base64 alphabets holds."""
    plus, minus = re.search("[+/]", run), re.search("[-_]", run)
    if not (plus and minus):
        return [(0, len(run))]
    out = {m.span() for rule in (WITHOUT_MINUS, WITHOUT_PLUS) for m in rule.finditer(run)}
    # a part inside another is tested with that
    return sorted(s for s in out if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t in out))


def candidates(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, p-value) of each candidate."""
    out = []
    for m in CANDIDATE.finditer(text):
        for a, b in parts(m[0]):
            found = infer(m[0][a:b])
            if found:
                out.append((m.start() + a, m.start() + b, found[0], battery(found[1], found[2])))
    return out


_FOUND = "doc_id long, base string, n_assign long, n_access long, n_hex long, cands array<struct<start:int,end:int,enc:string,p:double,bin:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("enc", pa.string()), ("p", pa.float64()), ("bin", pa.int32())]))
    for batch in batches:
        base, counts, cands = [], [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text) if text else []
            base.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))
            counts.append([sum(k == want for _, k, _ in spans) for want in range(3)])
            cands.append([{"start": a, "end": b, "enc": e, "p": p, "bin": _bin(p, b - a)} for a, b, e, p in (candidates(text) if text else [])])
        n = list(zip(*counts)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.string()), *(pa.array(x, pa.int64()) for x in n), pa.array(cands, kind)],
            names=["doc_id", "base", "n_assign", "n_access", "n_hex", "cands"],
        )


def _bin(p: float, length: int) -> int:
    """The bin of the weighted p-value; longer candidates have more weight, as tests tell more about them."""
    weighted = p / (length / TYPICAL_LENGTH)
    return min(BINS, max(0, int(-math.log10(max(weighted, 1e-300)) * PER_DECADE)))


def cuts(found: DataFrame, rate: float = RATE) -> DataFrame:
    """For each encoding, the bin from which on candidates are not random (Benjamini-Hochberg on binned p-values).

    At most BINS + 1 rows an encoding go through the windows, whatever the input.
    """
    bins = found.select(F.explode("cands").alias("c")).groupBy(F.col("c.enc").alias("enc"), F.col("c.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("c.end") - F.col("c.start")) / F.lit(float(TYPICAL_LENGTH))).alias("w"))
    ranked = bins.select(
        "enc",
        "bin",
        F.sum("n").over(Window.partitionBy("enc").orderBy(F.desc("bin"))).alias("rank"),
        F.sum("w").over(Window.partitionBy("enc")).alias("w"),
    )
    # the largest p of a bin is 10 ** (-bin / PER_DECADE); with the sum of the weights in m's place, they are 1 on average
    passed = F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE) * F.col("w") <= F.lit(rate) * F.col("rank")
    return ranked.groupBy("enc").agg(F.coalesce(F.min(F.when(passed, F.col("bin"))), F.lit(BINS + 1)).alias("cut"))


def _finish(limits: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, spans = [], []
            for base, cands in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist()):
                hashes.append(hashlib.sha256(base.encode()).hexdigest())
                all_spans = [(int(x.split(":")[1]), KINDS.index(x.split(":")[0]), int(x.split(":")[2])) for x in base.split(",") if x]
                all_spans += [(c["start"], 3, c["end"]) for c in cands if c["bin"] < limits.get(c["enc"], BINS + 1)]
                spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(all_spans)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:1], *batch.columns[2:5], pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row.

    A null text is empty and has no span; base_sha256 is then that of no bytes. Repeated
    rows are judged alike, each in its own row. Other columns are ignored.
    """
    from kvloom.llm.shared import checkpoint

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, _FOUND)
    found = checkpoint(found)  # the texts are read once; what was found in them is small
    limits = {r.enc: r.cut for r in cuts(found, rate).collect()}  # a row for each encoding
    return found.mapInArrow(_finish(limits), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
