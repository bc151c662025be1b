"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into segments that no piece can cross (before a space, around characters
that no piece has). Distinct segments that the task has not met before are joined to one text, whose
suffixes are sorted by their first characters, as many as the longest piece has. Each piece is
found by binary search as a range of suffixes; each occurrence is an edge. Edges are sorted by
their end and relaxed from left to right: an edge stands if it fits the piece that ends where it
begins. Two pieces fit if byte-pair merging of their joined text gives just these two, which their
merge trees tell: a merge across their border must not come before what consumes its ends. Each
place then has one piece that ends there, and the way back from a segment's end is its encoding,
the same as that of merging. Runs of spaces merge last of all and are looked up by length;
characters without a piece become bytes.

The vocabulary is read on the driver and sent to the tasks; its size is the model's. A task keeps
at most ``CACHE`` segments.

Edge cases: null and empty texts have no pieces and decode to an empty text; U+2581 counts as a
space, as it does in the format, and decodes to one; repeated rows are encoded alike; an empty
table gives no rows. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import span_hashes

SPACE = "▁"
CACHE, CHUNK_CHARS, LONG_SEGMENT = 1_000_000, 2_000_000, 64
NEVER = np.int64(1 << 62)


def _merged(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merging of a short text: what is left, and the last merge."""
    last = None
    while len(symbols) > 1:
        best = min((rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
        if best[0] == NEVER:
            break
        i = best[1]
        last = symbols[i], symbols[i + 1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols, last


@dataclass
class Vocabulary:
    """Pieces as arrays. Tokens here are numbers of usable pieces, ids are the model's."""

    ids: np.ndarray
    lengths: np.ndarray
    keys: np.ndarray  # first 16 characters, 4 in a column
    chars: np.ndarray  # code of each code point, 0 without a piece
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    right: np.ndarray  # spine from the last character upwards: tokens, then when each is consumed
    right_until: np.ndarray
    left: np.ndarray
    left_until: np.ndarray
    bigrams: np.ndarray
    runs: dict[str, int]
    byte_ids: np.ndarray
    space: int
    texts: list[bytes]  # by the model's ids

    @property
    def columns(self) -> int:
        return self.keys.shape[1]


def _pack(codes: np.ndarray, at: np.ndarray, columns: int) -> np.ndarray:
    """Four 16-bit codes in each column of 64 bits, from each place at."""
    padded = np.concatenate([codes, np.zeros(4 * columns, np.uint16)])
    out = np.zeros((len(at), columns), np.uint64)
    for k in range(4 * columns):
        out[:, k // 4] |= padded[at + k].astype(np.uint64) << np.uint64(16 * (3 - k % 4))
    return out


def load(model_path: str) -> Vocabulary:
    """The pieces of a byte-pair model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    assert all(model.is_byte(int(i)) for i in byte_ids), "the model has no byte fallback"
    texts = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
    runs = {names[i]: i for i in plain if set(names[i]) == {SPACE} and len(names[i]) > 1}
    usual = [i for i in plain if names[i] not in runs]
    assert all(SPACE not in names[i][1:] for i in usual), "a piece has a space after its first character"
    order = sorted(usual, key=lambda i: (-model.get_score(i), i))
    if runs:
        assert max(model.get_score(i) for i in runs.values()) < min(model.get_score(i) for i in usual if len(names[i]) > 1)
    rank = {names[i]: r for r, i in enumerate(order) if len(names[i]) > 1}
    splits = {}
    for p in list(rank):
        left, last = _merged(list(p), rank)
        if len(left) == 1:
            splits[p] = last
    tokens = [i for i in usual if len(names[i]) == 1 or names[i] in splits]
    number = {names[i]: t for t, i in enumerate(tokens)}
    alphabet = sorted({c for i in tokens for c in names[i]} | {SPACE})
    assert all(c in number for c in alphabet) and len(alphabet) < 65535, "a character has no piece of its own"
    chars = np.zeros(0x110000, np.uint16)
    chars[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
    chars[ord(" ")] = chars[ord(SPACE)]
    when: dict[str, int] = {}  # the moment a piece is formed, and its rank for pieces of one moment

    def formed(p: str) -> int:
        if p not in when:
            when[p] = -1 if len(p) == 1 else (max(rank[p], *(formed(q) >> 17 for q in splits[p])) << 17) + rank[p]
        return when[p]

    depth = max(max(len(names[i]) for i in tokens), 1)
    right, left = np.full((len(tokens), depth), -1, np.int32), np.full((len(tokens), depth), -1, np.int32)
    right_until, left_until = np.full((len(tokens), depth), NEVER), np.full((len(tokens), depth), NEVER)
    for t, i in enumerate(tokens):
        for end, spine, until in ((1, right, right_until), (0, left, left_until)):
            p, chain = names[i], []
            while True:
                chain.append(p)
                if len(p) == 1:
                    break
                p = splits[p][end]
            for k, p in enumerate(reversed(chain)):
                spine[t, k] = number[p]
                if k + 1 < len(chain):
                    until[t, k] = formed(chain[len(chain) - 2 - k])
    pairs = {}
    for p, r in rank.items():
        for k in range(1, len(p)):
            if p[:k] in number and p[k:] in number:
                pairs[number[p[:k]] << 20 | number[p[k:]]] = r
    pair_keys = np.array(sorted(pairs), np.int64)
    columns = -(-depth // 4)
    codes = [chars[[ord(c) for c in names[i]]] for i in tokens]
    lengths = np.array([len(c) for c in codes])
    keys = np.zeros((len(tokens), columns), np.uint64)
    for t, c in enumerate(codes):
        keys[t] = _pack(c, np.zeros(1, np.int64), columns)[0]
    bigrams = np.unique(np.concatenate([c[:-1].astype(np.int64) << 16 | c[1:] for c in codes]))
    return Vocabulary(np.array(tokens), lengths, keys, chars, pair_keys, np.array([pairs[k] for k in pair_keys.tolist()], np.int64), right, right_until, left, left_until, bigrams, runs, byte_ids, number[SPACE], texts)


def fits(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the text of tokens a and b gives these two."""
    good = np.ones(len(a), bool)
    i, j, live = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.arange(len(a))
    now = np.full(len(a), -1, np.int64)
    while len(live):
        x, y = a[live], b[live]
        key = v.right[x, i[live]].astype(np.int64) << 20 | v.left[y, j[live]]
        at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        there = v.pair_keys[at] == key
        ranks = v.pair_ranks[at]
        across = np.where(there, (np.maximum(ranks, now[live] >> 17) << 17) + ranks, NEVER)
        next_a, next_b = v.right_until[x, i[live]], v.left_until[y, j[live]]
        bad = there & (across < next_a) & (across <= next_b)
        good[live[bad]] = False
        step_a = next_a <= next_b
        i[live] += step_a & (next_a < NEVER)
        j[live] += ~step_a
        now[live] = np.minimum(next_a, next_b)
        live = live[~bad & (now[live] < NEVER)]
    return good


def suffixes(codes: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes in the order of their suffixes, and these suffixes' packed beginnings."""
    keys = _pack(codes, np.arange(len(codes)), columns)
    order = np.lexsort(tuple(keys[:, k] for k in range(columns - 1, -1, -1)))
    return order, keys[order]


def occurrences(v: Vocabulary, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the range of sorted suffixes that begin with it, by binary search."""
    tops = v.keys.copy()
    for k in range(v.columns):
        fill = np.clip(4 * (k + 1) - v.lengths, 0, 4)
        tops[:, k] |= np.where(fill > 0, (np.uint64(1) << (16 * np.minimum(fill, 3)).astype(np.uint64)) - np.uint64(1), np.uint64(0))
        tops[fill == 4, k] = np.uint64(0xFFFFFFFFFFFFFFFF)

    def bound(wanted, right):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            here = keys[np.minimum(mid, len(keys) - 1)]
            less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
            for k in range(keys.shape[1]):
                less |= same & (here[:, k] < wanted[:, k])
                same &= here[:, k] == wanted[:, k]
            go = (less | (same & right)) & (low < high)
            low, high = np.where(go, mid + 1, low), np.where(go, high, np.minimum(mid, high))
        return low

    return bound(v.keys, False), bound(tops, True)


class Encoder:
    """Encodes texts; keeps the segments it has met."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.parts, self.n = v, {}, [], 0
        self.run_ids: dict[int, list[int]] = {}
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.fit_keys, self.fit_values = np.zeros(0, np.int64), np.zeros(0, bool)
        self.salt = np.random.default_rng(77).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)

    def run(self, m: int) -> list[int]:
        """Ids of m spaces on their own."""
        if m not in self.run_ids:
            ranks = {p: 0 for p in self.v.runs}  # all of one score: the leftmost merge first
            left, _ = _merged([SPACE] * m, ranks)
            self.run_ids[m] = [self.v.runs.get(p, int(self.v.ids[self.v.space])) for p in left]
        return self.run_ids[m]

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        own, inverse = np.unique(a.astype(np.int64) << 20 | b, return_inverse=True)
        at = np.minimum(np.searchsorted(self.fit_keys, own), max(len(self.fit_keys) - 1, 0))
        new = self.fit_keys[at] != own if len(self.fit_keys) else np.ones(len(own), bool)
        if new.any():
            more = own[new]
            keys = np.concatenate([self.fit_keys, more])
            values = np.concatenate([self.fit_values, fits(self.v, more >> 20, more & ((1 << 20) - 1))])
            order = np.argsort(keys, kind="stable")
            self.fit_keys, self.fit_values = keys[order], values[order]
            at = np.searchsorted(self.fit_keys, own)
        return self.fit_values[at][inverse]

    def relax(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each segment codes[first : first + length] and their number; segments are
        parted by zeros."""
        v = self.v
        order, keys = suffixes(codes, v.columns)
        low, high = occurrences(v, keys)
        n = high - low
        token = np.repeat(np.arange(len(n)), n)
        begin = order[np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        segment = np.repeat(np.arange(len(first)), length + 1)[begin]
        end = begin - first[segment] + v.lengths[token]
        by_end = np.argsort(end, kind="stable")
        begin, token, end = begin[by_end], token[by_end], end[by_end]
        edges = np.searchsorted(end, np.arange(int(length.max(initial=0)) + 2))
        last = np.full(len(codes) + 1, -1, np.int64)  # the token that ends before a place
        is_first = np.zeros(len(codes) + 1, bool)
        is_first[first] = True
        for e in range(1, len(edges) - 1):
            at, t = begin[edges[e] : edges[e + 1]], token[edges[e] : edges[e + 1]]
            good = is_first[at].copy()
            inner = np.flatnonzero(~good)
            before = last[at[inner]]
            have = before >= 0
            inner, before = inner[have], before[have]
            good[inner] = self._fits(before, t[inner])
            last[at[good] + v.lengths[t[good]]] = t[good]
        # the way back, for all segments at once
        stop, rows, found = first + length, np.arange(len(first)), []
        live = length > 0
        stop, rows = stop[live], rows[live]
        while len(rows):
            t = last[stop]
            assert (t >= 0).all(), "a segment has no encoding"
            found.append((rows, t))
            stop = stop - v.lengths[t]
            on = stop > first[rows]
            stop, rows = stop[on], rows[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(first), np.int64)
        row, tok = np.concatenate([r for r, _ in found])[::-1], np.concatenate([t for _, t in found])[::-1]
        order = np.argsort(row, kind="stable")
        return tok[order], np.bincount(row, minlength=len(first))

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encode the segments codes[begin:end] and keep them by their hashes."""
        space = int(self.v.chars[ord(" ")])
        odd = codes[begin] == 0
        pieces, owner, parts = [], [], []  # what is relaxed: parts of segments
        spaces = np.zeros(len(begin), np.int64)
        for s in np.flatnonzero(~odd):
            c = codes[begin[s] : end[s]]
            if c[0] == space and len(c) > 1 and c[1] == space:
                k = int(np.argmax(c != space)) or len(c)
                spaces[s], c = k - 1, c[k - 1 :]
            if len(c) > LONG_SEGMENT:
                joint = c[:-1].astype(np.int64) << 16 | c[1:]
                at = np.minimum(np.searchsorted(self.v.bigrams, joint), len(self.v.bigrams) - 1)
                parts = np.split(c, np.flatnonzero(self.v.bigrams[at] != joint) + 1)
            else:
                parts = [c]
            pieces += parts
            owner += [s] * len(parts)
        counts, tokens = np.zeros(len(begin), np.int64), np.zeros(0, np.int64)
        if pieces:
            length = np.array([len(p) for p in pieces])
            first = np.cumsum(length + 1) - (length + 1)
            joined = np.zeros(int((length + 1).sum()), np.uint16)
            joined[np.repeat(first, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)] = np.concatenate(pieces)
            tokens, n = self.relax(joined, first, length)
            counts = np.bincount(np.array(owner), weights=n, minlength=len(begin)).astype(np.int64)
        ids = self.v.ids[tokens].astype(np.int32)
        starts = np.cumsum(counts) - counts
        special = np.flatnonzero(odd | (spaces > 0))
        if len(special):
            lists, at = [], 0
            for s in special:
                lists.append(ids[starts[at] : starts[s]] if s > at else ids[:0])
                own = ids[starts[s] : starts[s] + counts[s]]
                if odd[s]:
                    own = self.v.byte_ids[np.frombuffer(chr(int(points[begin[s]])).encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int32)
                elif len(own) and own[0] == self.v.ids[self.v.space]:
                    own = np.array(self.run(int(spaces[s]) + 1) + own[1:].tolist(), np.int32)
                else:
                    own = np.array(self.run(int(spaces[s])) + own.tolist(), np.int32)
                lists.append(own)
                counts[s] = len(own)
                at = s + 1
            if at < len(begin):
                lists.append(ids[starts[at] :])
            ids = np.concatenate(lists)
            starts = np.cumsum(counts) - counts
        for h in hashes.tolist():
            self.known[h] = len(self.known)
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's."""
        if len(self.known) > CACHE:
            self.__init__(self.v)
        joined = "".join(" " + t for t in texts if t)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) + 1 if t else 0 for t in texts])
        stop = np.cumsum(size)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        codes = self.v.chars[points]
        space = self.v.chars[ord(" ")]
        cut = codes == 0
        cut[1:] |= codes[:-1] == 0
        cut[1:] |= (codes[1:] == space) & (codes[:-1] != space)
        cut[(stop - size)[size > 0]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(codes))
        values = np.where(codes == 0, points.astype(np.uint64) * np.uint64(2) + np.uint64(1 << 40), self.salt[codes])
        hashes = span_hashes(values, begin, end)
        own, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        rows = np.array([self.known.get(h, -1) for h in own.tolist()])
        new = np.flatnonzero(rows < 0)
        if len(new):
            self._learn(own[new], codes, points, begin[at[new]], end[at[new]])
            rows[new] = np.arange(len(self.known) - len(new), len(self.known))
        row = rows[inverse]
        n = self.counts[row]
        where = np.repeat(self.starts[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        total = np.concatenate([[0], np.cumsum(n)])
        bounds = total[np.searchsorted(begin, np.concatenate([[0], stop]))]
        return self.ids[where], np.diff(bounds)


def decode(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of lists of ids, without the space that encoding puts first."""
    out, at = [], 0
    for n in counts.tolist():
        text = b"".join([v.texts[i] for i in ids[at : at + n].tolist()])
        out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "surrogatepass"))
        at += n
    return out


def _chunks(texts: list) -> list[tuple[int, int]]:
    out, lo, n = [], 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= CHUNK_CHARS:
            out.append((lo, i + 1))
            lo, n = i + 1, 0
    return [*out, (lo, len(texts))] if lo < len(texts) else out


def encode_texts(docs: DataFrame, v: Vocabulary, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all by default), and ids, n_ids, round_trip: whether the ids
    decode to the text (U+2581 taken as a space)."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    keep = docs.columns if keep is None else keep
    more = ["piece_ids", "n_pieces", "round_trip"]

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _chunks(texts):
                ids, counts = encoder.encode(texts[lo:hi])
                back = decode(shared.value, ids, counts)
                same = [b == (t or "").replace(SPACE, " ") for b, t in zip(back, texts[lo:hi], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in keep), lists, pa.array(counts), pa.array(same)], [*keep, *more])

    schema = docs.select(*keep, F.array(F.lit(0)).alias(more[0]), F.lit(0).cast("long").alias(more[1]), F.lit(True).alias(more[2])).schema
    return docs.mapInArrow(run, schema)
