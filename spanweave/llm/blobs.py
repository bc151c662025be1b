"""Numpy arrays as compressed binary values, for rows that carry many small records."""

from __future__ import annotations

import pickle

import numpy as np
import zstandard

_OUT, _IN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    return _OUT.compress(pickle.dumps([np.ascontiguousarray(a) for a in arrays], protocol=5))


def unpack(blob: bytes) -> list[np.ndarray]:
    return pickle.loads(_IN.decompress(blob))


def planes(values: np.ndarray, n: int) -> np.ndarray:
    """The n lowest bytes of each uint64, byte by byte, so that equal bytes stand together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :n].T)


def from_planes(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, : rows.shape[0]] = rows.T
    return out.view(np.uint64).ravel()


def splits(buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal buckets (0 to n - 1) together, and where each begins."""
    order = np.argsort(buckets.astype(np.uint16) if n <= 65536 else buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(n + 1))
