"""Words and shingles of many texts at once, as 64-bit hashes in NumPy arrays.

A chunk of texts is one byte array; prefix sums of byte values times powers of an odd base
give the hash of any byte range by two look-ups.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  #: bytes of text worked on at once; a longer text stands alone


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (SplitMix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
BYTE = mix(np.arange(1, 257, dtype=np.uint64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[32, *range(9, 14)]] = True
_tables: dict[str, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  #: of glibc


def release() -> None:
    """Give free memory back to the system. Workers outlive their tasks, and what they hold counts for their executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0..n and its inverses, modulo 2**64."""
    if len(_tables.get("pow", ())) <= n:
        size = max(CHUNK, n) + 1
        for name, base in (("pow", BASE), ("inv", pow(BASE, -1, 1 << 64))):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["pow"], _tables["inv"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] = hash of data[i:j] times BASE**i; see range_hash."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data))[0][: len(data)], out=p[1:])
    return p


def range_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each data[start:end], wherever it stands."""
    return (p[end] - p[start]) * powers(len(p))[1][start]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j with their UTF-8 bytes and offsets; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts take about `limit` bytes; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = IS_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of the first word of each text (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~white[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = IS_WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z lowered, and the number of the first word of each text."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, white)
    return mix(range_hash(prefix_hashes(data), starts, ends)), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; with fewer words the whole as one."""
    words, first = word_hashes(data, offsets)
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        runs = runs * np.uint64(BASE) + words[j : j + len(runs)]
    runs = mix(runs)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = mix(np.array([short ^ w]))[0]
            yield np.array([short])
        else:
            yield np.zeros(0, np.uint64)
