"""Vectorised views of Arrow string batches: words, hashes and window hashes.

All of it works on the UTF-8 bytes of many documents at once. Hashes are 64-bit
polynomials over a random byte table, the same for a word wherever it stands.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about this many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240131))
BYTE_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

#: Words between these bytes: space and the controls \t \n \v \f \r.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a multiplier modulo 2**64, and of its inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        c = MULTIPLIERS[which]
        both = []
        for x in (c, pow(c, -1, 1 << 64)):
            out = np.full(size, x, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out, out=out))
        have = _powers[which] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser, so that every bit of a hash depends on all of its input."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


#: What empties the tables that operators keep in a worker from task to task.
CLEAR: list[Callable[[], None]] = [_powers.clear]
_owner: list[str] = []


def enter(owner: str) -> None:
    """Called at the start of a task. Workers are used again by other stages; what another operator has left there goes,
    so that it doesn't add up."""
    if _owner != [owner]:
        for clear in CLEAR:
            clear()
        _owner[:] = [owner]
        trim()


class Texts:
    """Some documents joined by a separator byte: data, and where each begins and ends."""

    def __init__(self, parts: list, separator: bytes = b"\n"):
        self.joined = separator.join(parts) + separator
        self.data = np.frombuffer(self.joined, np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.begins = self.ends - lengths

    def __len__(self) -> int:
        return len(self.ends)

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and each document's first word number (n + 1 values)."""
        inside = ~separators[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate(([0], edges))
        starts, ends = edges[0::2], edges[1::2]
        first = np.searchsorted(starts, np.append(self.begins, len(self.data)))
        return starts, ends, first

    def hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None, which: int = 0) -> np.ndarray:
        """A hash of each span of bytes."""
        data = self.data if data is None else data
        up, down = powers(len(data) + 1, which)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_TABLE[data] * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(values: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each n consecutive values; len(values) - n + 1 of them, or none."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(values) + 1, which)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(values) - n + 1])


def owners(first: np.ndarray) -> np.ndarray:
    """The document number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def slices(column) -> list:
    """The UTF-8 bytes of each text of an Arrow array; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    out = [view[a:b] for a, b in zip(at, at[1:])]
    if column.null_count:
        out = [b"" if null else x for x, null in zip(out, column.is_null().to_pylist())]
    return out


def groups(parts: list, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes together."""
    begin = total = 0
    for i, part in enumerate(parts):
        if total and total + len(part) > most:
            yield begin, i
            begin, total = i, 0
        total += len(part) + 1
    if begin < len(parts):
        yield begin, len(parts)


def signed(h: np.ndarray) -> np.ndarray:
    """Hashes as Spark's long."""
    return h.view(np.int64)
