"""Substring dedup: seed and extend on winnowed anchors.

Every window of ``window`` consecutive words is represented by its anchor, the run of
``anchor`` words with the least hash in it (the leftmost of equals), so equal windows have
equal anchors at equal offsets. Documents are joined on anchors: each occurrence goes to the
anchor's bucket with hashes of how it extends to both sides, one for each window it stands
for. Anchors that occur once end there. Occurrences of the others are matched extension by
extension; a window whose words also start elsewhere is a repeat, and overlapping repeats of a
document unite to maximal ones, whose words are removed from it. All windows are judged on the
input.

No pairs are made, so a passage shared by n documents costs n records. Windows that occur
again within a task's own batch are marked there, and one of them goes on: a hot passage
reaches its bucket once for each batch, not once for each document. The buckets number as many
as the session's shuffle partitions.

Edge cases: null and empty texts have no words and stay empty; texts under ``window`` words are
kept whole (words joined by one space); repeated rows repeat each other, as equal texts do; null
ids are kept; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import from_planes, pack, planes, splits, unpack
from .common import shuffle_partitions
from .text_arrays import SPACED, Words, chunks, gram_hashes

WINDOW, ANCHOR = 35, 20
FLUSH_WORDS = 1_000_000


def winnowed(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of window words: the hash of its anchor and the anchor's place."""
    least = gram_hashes(words, anchor)
    place = np.arange(len(least))
    reach, want = 1, window - anchor + 1
    while reach < want:  # minima over 1, 2, 4, ... places, the last step overlapping
        hop = min(reach, want - reach)
        left, right = least[:-hop], least[hop:]
        later = right < left
        least, place = np.where(later, right, left), np.where(later, place[hop:], place[:-hop])
        reach += hop
    return least, place


def _runs(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive starts of each key: keys, and int32 rows (start, length)."""
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return keys[at], np.stack([starts[at], np.diff(np.append(at, len(keys)))], axis=1).astype(np.int32)


def _dealt(keys: np.ndarray, runs: np.ndarray, n_buckets: int) -> tuple[list[int], list[bytes]]:
    """Runs of all keys as one payload for each bucket of keys."""
    order, at = splits(keys % n_buckets, n_buckets)
    used = np.flatnonzero(np.diff(at))
    return [int(b) for b in used], [pack(keys[order[at[b] : at[b + 1]]], runs[order[at[b] : at[b + 1]]]) for b in used]


SEEDS = "bucket int, marked boolean, payload binary"


def seeds(n_buckets: int, window: int, anchor: int):
    """Batches of (key, text) to anchors for buckets, and to marked runs of windows that repeat here."""

    def flush(found):
        hashes, anchors, keys, starts, places = (np.concatenate(x) for x in zip(*found, strict=True))
        _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        buckets, payloads = _dealt(*_runs(keys[again], starts[again]), n_buckets)
        yield buckets, True, payloads
        sent = np.sort(first)
        hashes, anchors, keys, starts, places = (x[sent] for x in (hashes, anchors, keys, starts, places))
        order, at = splits((anchors % np.uint64(n_buckets)).astype(np.int64), n_buckets)
        buckets, payloads = [], []
        for b in np.flatnonzero(np.diff(at)):
            rows = order[at[b] : at[b + 1]]  # in the order of documents and places
            k, s, p = keys[rows], starts[rows], places[rows]
            new = np.ones(len(rows), bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1) | (p[1:] != p[:-1])
            head = np.flatnonzero(new)
            own, index = np.unique(k[head], return_inverse=True)
            payloads.append(pack(own, index.astype(np.int32), s[head].astype(np.int32), np.diff(np.append(head, len(rows))).astype(np.uint16), planes(anchors[rows][head], 8), planes(hashes[rows], 6)))
            buckets.append(int(b))
        yield buckets, False, payloads

    def record(buckets, marked, payloads):
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([marked] * len(buckets), pa.bool_()), pa.array(payloads, pa.binary())], ["bucket", "marked", "payload"])

    def run(batches):
        found, n, passed = [], 0, 0
        for batch in batches:
            ids = batch.column("key").to_numpy()
            for lo, hi, words in chunks(batch.column("text"), SPACED):
                valid = np.arange(len(words.starts)) + window <= np.repeat(words.first[1:], words.counts)
                if valid.any():
                    w = words.hashes()
                    least, place = winnowed(w, window, anchor)
                    at = np.flatnonzero(valid)
                    doc = words.doc[at]
                    found.append((gram_hashes(w, window)[at], least[at], ids[lo:hi][doc], at - words.first[doc], place[at] + passed))
                    n += len(at)
                    passed += len(w)
                if n >= FLUSH_WORDS:
                    for out in flush(found):
                        yield record(*out)
                    found, n = [], 0
        if n:
            for out in flush(found):
                yield record(*out)

    return run


def extend(n_buckets: int):
    """One bucket: anchors that occur again, extended; marked runs pass on with what is found."""

    def run(table: pa.Table) -> pa.Table:
        parts = [(m.as_py(), unpack(b.as_py())) for m, b in zip(table["marked"], table["payload"], strict=True)]
        keys, runs = ([p[i] for m, p in parts if m] for i in (0, 1))
        parts = [p for m, p in parts if not m]
        if parts:
            key = np.concatenate([p[0][p[1]] for p in parts])
            start, n = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]).astype(np.int64)
            anchor, hashes = np.concatenate([from_planes(p[4]) for p in parts]), np.concatenate([from_planes(p[5]) for p in parts])
            _, index, counts = np.unique(anchor, return_inverse=True, return_counts=True)
            rows = np.repeat(np.arange(len(key)), n)
            kept = counts[index[rows]] > 1
            step = (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n))[kept]
            rows, hashes = rows[kept], hashes[kept]
            both = hashes | (index[rows].astype(np.uint64) << np.uint64(48))
            _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
            again = counts[inverse] > 1
            own, found = _runs(key[rows[again]], start[rows[again]] + step[again])
            keys.append(own)
            runs.append(found)
        buckets, payloads = _dealt(np.concatenate(keys), np.concatenate(runs), n_buckets)
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    return run


def gather(table: pa.Table) -> pa.Table:
    """One bucket of keys: all runs of each key, one after another."""
    parts = [unpack(b.as_py()) for b in table["payload"]]
    keys, runs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    own, first = np.unique(keys[order], return_index=True)
    runs = runs[order]
    return pa.table({"key": pa.array(own), "runs": pa.array([runs[a:b].tobytes() for a, b in zip(first, np.append(first, len(keys))[1:], strict=True)], pa.binary())})


def covered(words: Words, runs: list, window: int) -> np.ndarray:
    """Words inside any run of repeated windows; runs: bytes of each document, or None."""
    edge = np.zeros(len(words.starts) + 1, np.int32)
    for d, own in enumerate(runs):
        if own:
            a = np.frombuffer(own, np.int32).reshape(-1, 2)
            np.add.at(edge, words.first[d] + a[:, 0], 1)
            np.add.at(edge, words.first[d] + a[:, 0] + a[:, 1] + window - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def joined_words(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    at = np.flatnonzero(kept)
    n = np.bincount(words.doc[at], minlength=len(words.counts))
    last = np.zeros(len(at), bool)
    last[np.cumsum(n)[n > 0] - 1] = True
    data = words.data.copy()
    stops = words.ends[at]
    data[stops[~last]] = 0x20
    edge = np.zeros(len(data) + 2, np.int32)
    edge[words.starts[at]] += 1
    np.add.at(edge, stops + ~last, -1)
    size = (stops - words.starts[at] + ~last).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
    body = data[np.cumsum(edge)[: len(data)] > 0]
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)])


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    sown = rows.select("key", "text").mapInArrow(seeds(n, window, anchor), SEEDS)
    runs = sown.groupBy("bucket").applyInArrow(extend(n), "bucket int, payload binary")
    runs = runs.groupBy("bucket").applyInArrow(gather, "key long, runs binary")

    def take(batches):
        for batch in batches:
            for lo, hi, words in chunks(batch.column("text"), SPACED):
                gone = covered(words, batch.column("runs").slice(lo, hi - lo).to_pylist(), window)
                removed = np.bincount(words.doc[gone], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), joined_words(words, ~gone).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(runs, "key", "left").mapInArrow(take, f"doc_id {kind}, n_words long, n_removed long, kept string")
