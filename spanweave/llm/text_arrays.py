"""Words of Arrow string columns as numpy arrays, without a Python string for each word.

Hashes are sums of random byte values times powers of an odd number modulo 2**64, so that
prefix sums give the hash of every span at once; a final mix spreads their bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, list[np.ndarray]] = {}

#: Byte classes. SPACED: all but space and 0x09-0x0D. ALNUM: digits, a-z and non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        factors = [np.full(size, b, np.uint64) for b in (_BASE, inverse)]
        for f in factors:
            f[0] = 1
        _POWERS[0] = have = [np.multiply.accumulate(f) for f in factors]
    return have[0], have[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of values[s:e] (uint64) for each pair of starts and ends."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (uint64), documents not regarded."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(words, at, at + k)


class Words:
    """Words of some documents. doc: index in this chunk; starts, ends: byte places in data;
    first: for each document the index of its first word, and the number of words at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        low = int(offsets[0])
        offsets = offsets - low
        data = data[low : low + int(offsets[-1])]
        self.data = LOWER[data] if lower else data
        inside = kind[self.data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hashes of the words, or of their first bytes."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return span_hashes(_BYTE[self.data], self.starts, ends)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words), some CHUNK_BYTES at a time; a document is never split."""
    data, offsets = raw(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, row + 1), n)
        yield row, to, Words(data, offsets[row : to + 1], kind, lower)
        row = to
