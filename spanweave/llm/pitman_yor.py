"""LM scoring: a hierarchical Pitman-Yor model of words given the word before.

Every context word has a restaurant whose dishes are the words that follow it; all of them share
one parent restaurant, whose base is uniform over the training words and one unknown word. The
seating is held as the number of tables of each dish; each table of a context sends one customer
to the parent.

Sampling is Gibbs with auxiliary variables. Given the rest, the tables t of a dish with c customers
have probability proportional to S(c, t) d^t (strength / d + own total)... : the last factor ties a
restaurant's dishes together. A gamma variable for each restaurant, drawn given its total, makes
it a product, so that the dishes of a restaurant are independent and drawn at once:
S(c, t) (d gamma)^t h(1) .. h(t), where S are generalised Stirling numbers and h(k) is what the parent
gives for the k-th table, this dish's own tables taken out of the parent before. S is exact up to ``EXACT``
customers; beyond, it is the saddle point of its generating function, with the error at ``EXACT``
taken off (within a hundredth in total variation, see the tests): numerics, not another model.

Contexts are dealt to buckets and sampled there, ``PARTS`` parts of a bucket after another, each
seeing what the others have drawn, for ``SWEEPS`` sweeps; then the buckets exchange the parent's
counts and the parent is sampled. Between exchanges a bucket knows the parent's customers of other buckets
as they were (the usual approximate distributed Gibbs). After ``BURN_IN`` rounds, the predictive
probabilities of ``SAMPLES`` * ``SWEEPS`` states are averaged. Discounts come from the counts of counts,
strengths are fixed.

How it runs: documents are read in batches; a batch's occurrences (context, word, document's number in the
batch) go once to buckets by context, packed as arrays, words that are common as codes from a
bounded table. The number of buckets follows from the number of tokens. Contexts that hold more than
a quarter of a bucket are split by word, and their totals (a bounded table) go through the driver. Pairs
with ``FAT`` documents or more in a batch send their counts alone to the bucket; their documents stay in rows of
the batch, which are joined with the pair's probability in the end, so that a hot pair gathers nowhere. A
bucket asks word buckets for what it needs of its words, and answers come back aligned. Only
scalars and bounded tables reach the driver.

Edge cases: null and empty texts are one end token; without training rows every word is unknown
and N is 0; repeated rows are scored alike (each counts as training text if it is to be learned
from); null ids are kept; an empty table gives no rows. Other columns are ignored. Words are
told apart by 64 bits of a hash.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import from_planes, pack, planes, splits, unpack
from .common import cut, shuffle_partitions
from .text_arrays import SPACED, chunks, mix

FLUSH_WORDS = 1_200_000
BUCKET_TOKENS = 1_200_000
#: Words with a code, at most; each code and place of a word in a bucket takes WIDE bits at most.
COMMON, WIDE = 1 << 18, 26
FAT = 64
BEGIN, END = np.uint64(1), np.uint64(2)
EXACT = 400
#: Weights of more customers are taken for so many tables at first; those of KNOWN numbers of customers are kept.
FIRST, KNOWN = 512, 4096
BURN_IN, SAMPLES, SWEEPS, PARTS = 2, 2, 5, 4
STRENGTH_ROOT, STRENGTH = 10.0, 1.0
#: Sums cross the network as whole numbers of these units.
BASE_UNIT, SCORE_UNIT = 2.0**-26, 2.0**-20


@dataclass
class Level:
    discount: float
    strength: float


def ints(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on, in as few bytes each as the greatest needs."""
    values = np.asarray(values).astype(np.uint64)
    return planes(values, max(1, (int(values.max(initial=0)).bit_length() + 7) // 8))


def steps_of(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs in order of c and w, by their distances."""
    return ints(np.diff((c.astype(np.int64) << WIDE) | w, prepend=0))


def pairs_of(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.cumsum(from_planes(steps).astype(np.int64) if steps.ndim == 2 else steps)
    return both >> WIDE, both & ((1 << WIDE) - 1)


def tokens(batches):
    """(keys, train, document, context, word) of some documents; each ends in an end token."""
    for batch in batches:
        keys, train = batch.column("key").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
        for lo, hi, words in chunks(batch.column("text"), SPACED, lower=True):
            n, count = hi - lo, words.counts + 1
            ends = np.cumsum(count)
            word = np.empty(int(ends[-1]), np.uint64)
            word[ends - 1] = END
            plain = np.ones(len(word), bool)
            plain[ends - 1] = False
            word[plain] = np.maximum(words.hashes(), np.uint64(3))
            context = np.empty_like(word)
            context[1:], context[ends - count] = word[:-1], BEGIN
            yield keys[lo:hi], train[lo:hi], np.repeat(np.arange(n), count), context, word


def frequent(batches):
    """Contexts that stand out in a chunk with their counts there, and the chunk's size."""
    for _, _, _, context, _ in tokens(batches):
        own, n = np.unique(context, return_counts=True)
        big = n >= max(1, min(7, len(context) // 40_000))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own[big].view(np.int64), -1)), pa.array(np.append(n[big], len(context)))], ["context", "n"])


def home(batch: int, n_buckets: int) -> int:
    """The bucket of a batch's documents. Numbers of batches have the scan's partition in their upper bits, so they are mixed first."""
    return int(mix(np.array([batch], np.uint64))[0] % np.uint64(n_buckets))


DEALT = "kind int, bucket int, id long, n long, payload binary"
PACKED, DOCS, FATS = range(3)


def deal(n_buckets: int, common: np.ndarray, hot: np.ndarray):
    """Occurrences packed by bucket; each batch's documents; documents of each fat pair."""

    def coded(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(common, x), max(len(common) - 1, 0))
        return np.where(common[at] == x, at, -1) if len(common) else np.full(len(x), -1)

    def flush(found, batch: int):
        sizes = np.array([len(f[0]) for f in found])
        keys, train = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        doc = np.concatenate([(f[2] + base).astype(np.int32) for f, base in zip(found, np.cumsum(sizes) - sizes, strict=True)])
        context, word = (np.concatenate([f[i] for f in found]) for i in (3, 4))
        found.clear()
        yield DOCS, home(batch, n_buckets), batch, None, pack(keys, ints(np.bincount(doc, minlength=len(keys))))
        where = context.copy()
        split = np.isin(context, hot)
        where[split] = mix(context[split] ^ (word[split] << np.uint64(3)))
        order, at = splits((where % np.uint64(n_buckets)).astype(np.int64), n_buckets)
        codes = coded(context), coded(word)
        for b in np.flatnonzero(np.diff(at)):
            rows = order[at[b] : at[b + 1]]
            c, w, d = codes[0][rows], codes[1][rows], doc[rows]
            rare = np.flatnonzero(c < 0), np.flatnonzero(w < 0)
            names = context[rows[rare[0]]], word[rows[rare[1]]]
            table = np.unique(np.concatenate(names))
            c[rare[0]], w[rare[1]] = (COMMON + np.searchsorted(table, x) for x in names)
            sort = np.lexsort((d, w, c))
            c, w, d = c[sort], w[sort], d[sort]
            new = np.ones(len(c), bool)  # a document's occurrences of a pair are one entry
            new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1]) | (d[1:] != d[:-1])
            head = np.flatnonzero(new)
            times = np.diff(np.append(head, len(c)))
            c, w, d = c[head], w[head], d[head]
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
            pair = np.flatnonzero(new)
            size = np.diff(np.append(pair, len(c)))
            learned = np.add.reduceat(times * train[d], pair)
            hash_of = lambda x: common[x] if x < COMMON else table[x - COMMON]
            fat = size >= FAT
            for p in np.flatnonzero(fat):
                own = slice(pair[p], pair[p] + size[p])
                yield FATS, home(batch, n_buckets), pair_key(hash_of(c[pair[p]]), hash_of(w[pair[p]])), batch, pack(ints(d[own]), ints(times[own]))
            thin = ~np.repeat(fat, size)
            yield PACKED, int(b), batch, None, pack(planes(table, 8), steps_of(c[pair], w[pair]), ints(learned), ints(np.where(fat, 0, size)), fat, ints(d[thin]), ints(times[thin]))

    def run(batches):
        # the scan's partition and the batch's number in it: the same when a lost task runs again
        base = TaskContext.get().partitionId() << 32
        found, n, number = [], 0, 0
        for part in tokens(batches):
            found.append(part)
            n += len(part[4])
            if n >= FLUSH_WORDS:
                yield from records(flush(found, base + number))
                n, number = 0, number + 1
        if found:
            yield from records(flush(found, base + number))

    def records(rows):
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["kind", "bucket", "id", "n", "payload"])

    return run


def pair_key(context, word) -> int:
    """A signed hash of a pair of words."""
    return int(mix(np.array([context], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([word], np.uint64)).view(np.int64)[0])


ROWS = "kind int, bucket int, peer int, payload binary, id long, n long, t long"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in ROWS.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})


STATE, SEATS, ASK, HOT, TOTAL, COUNTS, PARENT, TABLES, DIRECTORY, LISTED, KEPT = range(11)


def build(n_buckets: int, common: np.ndarray, hot: np.ndarray):
    """One bucket: its words, pairs, occurrences, and what it asks of the word buckets."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        apart = table.filter(pa.compute.not_equal(table["kind"], PACKED)).select(["kind", "id", "n", "payload"])
        passed = [({DOCS: LISTED, FATS: KEPT}[k], bucket, None, p, i, m, None) for k, i, m, p in zip(*(apart[c].to_pylist() for c in ("kind", "id", "n", "payload")), strict=True)]
        table = table.filter(pa.compute.equal(table["kind"], PACKED))
        if not len(table):
            return _rows(passed)
        batches = table["id"].to_numpy()
        parts = [unpack(b.as_py()) for b in table["payload"]]
        tables = [from_planes(p[0]) for p in parts]
        coded = [pairs_of(p[1]) for p in parts]
        used = np.zeros(COMMON, bool)
        for x in coded:
            for codes in x:
                used[codes[codes < COMMON]] = True
        words = np.unique(np.concatenate([common[used[: len(common)]], *tables]))
        words = words[np.lexsort((words, words % np.uint64(n_buckets)))]
        sort = np.argsort(words)
        where = lambda x: sort[np.minimum(np.searchsorted(words, x, sorter=sort), len(words) - 1)]
        shared = np.append(where(common), 0) if len(common) else np.zeros(1, np.int64)

        def places(codes: np.ndarray, own: np.ndarray) -> np.ndarray:
            return np.where(codes < COMMON, shared[np.minimum(codes, len(shared) - 1)], own[np.maximum(codes - COMMON, 0)])

        found = [(places(c, own), places(w, own)) for (c, w), own in ((x, np.append(where(t), 0)) for x, t in zip(coded, tables, strict=True))]
        c, w = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        learned, size = (np.concatenate([from_planes(p[i]).astype(np.int64) for p in parts]) for i in (2, 3))
        fat = np.concatenate([p[4] for p in parts])
        d, times = (np.concatenate([from_planes(p[i]).astype(np.int64) for p in parts]) for i in (5, 6))
        part = np.repeat(np.arange(len(parts)), [len(x[0]) for x in coded])
        both = c * len(words) + w
        order = np.lexsort((part, both))
        begin = (np.cumsum(size) - size)[order]
        entries = np.repeat(begin - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(int(size.sum()))
        d, times, source = d[entries], times[entries], np.repeat(part[order], size[order])
        both = both[order]
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        at = np.flatnonzero(new)
        pair_c, pair_w = both[at] // len(words), both[at] % len(words)
        add = lambda x: np.add.reduceat(x[order].astype(np.int64), at)
        learned, size, fat = add(learned), add(size), add(fat) > 0
        known = learned > 0
        n = len(words)
        count = lambda x, weights=None: np.bincount(x, weights=weights, minlength=n).astype(np.int64)
        customers, tables_of = count(pair_c, learned), count(pair_c[known])
        ones, many = learned == 1, learned > 1
        is_hot = np.flatnonzero(np.isin(words, hot))
        ask = np.flatnonzero(count(pair_w) > 0)
        word_count, word_tables = count(pair_w, learned), count(pair_w[known])
        names = np.array([pair_key(words[i], words[j]) for i, j in zip(pair_c[fat], pair_w[fat], strict=True)], np.int64)
        rows = [*passed, (STATE, bucket, None, pack(steps_of(pair_c, pair_w), ints(learned), ints(size), ints(d), ints(times), ints(source), batches, ints(ask), ints(customers), is_hot, words[is_hot], np.flatnonzero(fat), names), None, None, None)]
        rows.append((SEATS, bucket, None, pack(pair_c[many].astype(np.uint32), pair_w[many].astype(np.uint32), learned[many].astype(np.uint32), ints(count(pair_c[ones])), ints(count(pair_w[ones])), (words % np.uint64(n_buckets)).astype(np.uint32), ask.astype(np.uint32), is_hot, words[is_hot]), None, None, None))
        peer = (words[ask] % np.uint64(n_buckets)).astype(np.int64)
        edges = np.searchsorted(peer, np.arange(n_buckets + 1))
        for q in np.flatnonzero(np.diff(edges)):
            x = ask[edges[q] : edges[q + 1]]
            rows.append((ASK, bucket, int(q), pack(planes(words[x], 8), ints(word_count[x]), ints(word_tables[x])), None, None, None))
        rows += [(HOT, bucket, None, None, int(words[i].view(np.int64)), int(customers[i]), int(tables_of[i])) for i in is_hot]
        rows.append((TOTAL, bucket, None, None, None, int((learned == 1).sum()), int((learned == 2).sum())))
        return _rows(rows)

    return run


class Stirling:
    """log S(c, t) of a discount, up to what does not depend on t: ways to seat c customers at t tables."""

    def __init__(self, discount: float, exact: int = EXACT, points: int = 100_000):
        d = self.discount = discount
        s = np.full((exact + 1, exact + 1), -np.inf)
        s[1, 1] = 0
        for c in range(1, exact):
            t = np.arange(1, c + 1)
            s[c + 1, 1 : c + 1] = s[c, 1 : c + 1] + np.log(c - d * t)
            s[c + 1, 2 : c + 2] = np.logaddexp(s[c + 1, 2 : c + 2], s[c, 1 : c + 1])
        self.exact, self.table, self.known = exact, s, {}
        # saddle points z of ((1 - (1 - z)^d) / d)^t / z^c, by log(c / t)
        far = -np.exp(np.linspace(math.log(1e-7), math.log(40 / (1 - d)), points))  # log(1 - z)
        z, rest = -np.expm1(far), -np.expm1(d * far)
        mean = d * z * np.exp((d - 1) * far) / rest
        spread = mean * (1 + z * (1 - d) * np.exp(-far) - mean)
        self.ratio, self.value, self.spread = np.log(mean), np.log(rest / d) - mean * np.log(z), np.log(np.maximum(spread, 1e-300))
        half = np.arange(1, exact // 2 + 1)
        self.off = s[exact, 1 : exact // 2 + 1] - self._saddle(exact, half)

    def _saddle(self, c: int, t: np.ndarray) -> np.ndarray:
        r = np.log(c / t)
        return t * np.interp(r, self.ratio, self.value) - 0.5 * (np.log(t) + np.interp(r, self.ratio, self.spread)) - np.cumsum(np.log(np.arange(1, len(t) + 1)))

    def of(self, c: int, most: int) -> np.ndarray:
        """log S(c, t) for t from 1 to most, which is c at most."""
        if c <= self.exact:
            return self.table[c, 1 : most + 1]
        if (c, most) in self.known:
            return self.known[c, most]
        t = np.arange(1, most + 1)
        found = self._saddle(c, t) + self.off[np.minimum(t, len(self.off)) - 1]
        if most <= FIRST and len(self.known) < KNOWN:
            self.known[c, most] = found
        return found


@dataclass
class Back:
    """What a parent gives for dishes: (value + k + new) / (seats + k) for the table after k tables
    of this dish; a dish nobody else has there opens a table with its first."""

    value: np.ndarray
    new: float
    seats: float
    discount: float

    def logs(self, rows: np.ndarray, most: int) -> np.ndarray:
        k = np.arange(most)
        value = self.value[rows][:, None]
        return np.log(value + k + self.new - self.discount * ((value == 0) & (k > 0))) - np.log(self.seats + k)

    def ratios(self, rows: np.ndarray, most: int) -> np.ndarray:
        """exp of logs for each further table, from the second on: tables by rows."""
        k, value = np.arange(1, most)[:, None], self.value[rows]
        return (value + (self.new - self.discount * (value == 0)) + k) / (self.seats + k)


@dataclass
class Flat:
    """A uniform base."""

    log: float

    def logs(self, rows: np.ndarray, most: int) -> np.ndarray:
        return np.full((len(rows), most), self.log)

    def ratios(self, rows: np.ndarray, most: int) -> np.ndarray:
        return np.full((most - 1, len(rows)), math.exp(self.log))


def _draw_few(out: np.ndarray, rows: np.ndarray, c: int, log_pull: np.ndarray, back, stirling: Stirling, rng) -> np.ndarray:
    """Tables of dishes with c customers, from weights in proportion to that of one table; the rows whose weights
    are too large for that are returned. One uniform number a dish and no logarithms of single weights."""
    step = np.exp(np.diff(stirling.of(c, c)))[:, None] * np.exp(log_pull[rows])
    step *= back.ratios(rows, c)
    below = np.empty((c, len(rows)))
    below[0] = weight = np.ones(len(rows))
    with np.errstate(over="ignore", invalid="ignore"):
        if len(rows) < c:
            below[1:] = 1 + np.cumsum(np.cumprod(step, axis=0), axis=0)
        else:
            for t in range(1, c):
                weight = weight * step[t - 1]
                np.add(below[t - 1], weight, out=below[t])
    fits = below[-1] < 1e300
    out[rows] = np.where(fits, 1 + (below[:-1] <= rng.random(len(rows)) * below[-1]).sum(axis=0), 1)
    return rows[~fits]


@lru_cache(8)
def stirling_of(discount: float) -> Stirling:
    """Kept from task to task."""
    return Stirling(discount)


def draw_tables(customers: np.ndarray, log_pull: np.ndarray, back, stirling: Stirling, rng) -> np.ndarray:
    """A Gibbs step: tables of each dish given its customers, log_pull (the log of the discount and
    the auxiliary variable of its restaurant) and what the parent gives."""
    out = np.minimum(customers, 1)
    order = np.argsort(customers, kind="stable")
    sizes, first = np.unique(customers[order], return_index=True)
    for c, lo, hi in zip(sizes.tolist(), first, np.append(first[1:], len(order)), strict=True):
        if c < 2:
            continue
        rows = order[lo:hi]
        if c <= stirling.exact:
            rows = _draw_few(out, rows, c, log_pull, back, stirling, rng)
            if not len(rows):
                continue
        most = c if c <= stirling.exact else min(c, FIRST)
        while True:
            weight = stirling.of(c, most) + np.cumsum(back.logs(rows, most) + log_pull[rows][:, None], axis=1)
            if most == c or (weight[:, -1] < weight.max(axis=1) - 40).all():
                break
            most = min(c, most * 4)
        out[rows] = 1 + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
    return out


def _answers(table: pa.Table, kind: int) -> list[tuple[int, list]]:
    """Payloads of a kind by sample number, each put together in the order of peers."""
    picked = table.filter(pa.compute.equal(table["kind"], kind)).sort_by([("n", "ascending"), ("peer", "ascending")])
    out: dict[int, list] = {}
    for n, payload in zip(picked["n"].to_pylist(), picked["payload"], strict=True):
        out.setdefault(n, []).append([from_planes(x) if x.ndim == 2 else x for x in unpack(payload.as_py())])
    return [(n, [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(len(parts[0]))]) for n, parts in sorted(out.items())]


def first_answers(table: pa.Table) -> pa.Table:
    """One word bucket: who asked for which words, and the words' training counts."""
    q = table["peer"][0].as_py()
    asked = sorted(((b, [from_planes(x) for x in unpack(p.as_py())]) for b, p in zip(table["bucket"].to_pylist(), table["payload"], strict=True)), key=lambda x: x[0])
    words, index = np.unique(np.concatenate([p[0] for _, p in asked]), return_inverse=True)
    count = np.bincount(index, weights=np.concatenate([p[1] for _, p in asked]).astype(float), minlength=len(words)).astype(np.int64)
    ends = np.cumsum([len(p[0]) for _, p in asked])
    rows = [(DIRECTORY, q, None, pack(np.array([b for b, _ in asked]), ends, index.astype(np.uint32), np.concatenate([p[2] for _, p in asked]).astype(np.int64), np.array([len(words)])), None, None, None)]
    for (b, _), at in zip(asked, np.split(index, ends[:-1]), strict=True):
        rows.append((COUNTS, b, q, pack(ints(count[at])), None, 0, None))
    rows.append((TOTAL, q, None, None, None, int(count.sum()), int((count > 0).sum())))
    return _rows(rows)


def parent_answers(level: Level, vocabulary: int, gamma: float, seed: int, number: int):
    """One word bucket, one round: the parent's customers, a Gibbs step, and answers. gamma: the
    auxiliary variable of the parent."""

    def run(directory: pa.Table, told: pa.Table) -> pa.Table:
        q = directory["bucket"][0].as_py()
        buckets, ends, index, first, size = unpack(directory["payload"][0].as_py())
        by_bucket = {b: from_planes(unpack(p.as_py())[0]) for b, p in zip(told["bucket"].to_pylist(), told["payload"], strict=True)}
        sent = np.concatenate([by_bucket[b] for b in buckets.tolist()]) if by_bucket else first
        customers = np.bincount(index, weights=sent.astype(float), minlength=int(size[0])).astype(np.int64)
        rng = np.random.default_rng([seed, number, q, 1])
        tables = draw_tables(customers, np.full(len(customers), math.log(level.discount * gamma)), Flat(-math.log(vocabulary + 1)), stirling_of(level.discount), rng)
        rows = [(PARENT, int(b), q, pack(ints(customers[at]), ints(tables[at])), None, number, None) for b, at in zip(buckets, np.split(index, ends[:-1]), strict=True)]
        rows.append((TOTAL, q, None, None, None, int(customers.sum()), int(tables.sum())))
        rows.append((HOT, q, None, None, None, int((customers == 1).sum()), int((customers == 2).sum())))
        return _rows(rows)

    return run


@dataclass
class Root:
    """The parent's scalars in one sample."""

    level: Level
    customers: int
    tables: int
    vocabulary: int

    def new(self) -> float:
        return (self.level.strength + self.level.discount * self.tables) / (self.vocabulary + 1)

    def probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.level.discount * np.minimum(tables, customers) + self.new()) / (self.level.strength + self.customers)


class Seating:
    """A bucket's contexts: what is sampled of them, and the parent as this bucket knows it."""

    def __init__(self, level: Level, root: Root, c, w, customers, tables, total, parent_customers, parent_tables, rng):
        self.level, self.root, self.rng = level, root, rng
        self.c, self.w, self.customers, self.tables = (x.astype(np.int64) for x in (c, w, customers, tables))
        self.total, self.parent_customers, self.parent_tables = total, parent_customers, parent_tables
        self.stirling = stirling_of(level.discount)
        part = mix(self.c.astype(np.uint64) + np.uint64(1)) % np.uint64(PARTS)
        order = np.argsort(self.customers, kind="stable")
        parts = [order[part[order] == p] for p in range(PARTS)]
        # a part's dishes, its contexts, and which of these a dish has
        self.parts = [(rows, *np.unique(self.c[rows], return_inverse=True)) for rows in parts]

    def sweep(self) -> None:
        d = self.level.discount
        root = self.root.level
        for part, own, of in self.parts:
            c, w, mine = self.c[part], self.w[part], self.tables[part]
            gamma = self.rng.gamma(self.level.strength / d + self.total[own])
            others = self.parent_customers[w] - mine
            value = np.maximum(others - root.discount * np.minimum(self.parent_tables[w], others), 0.0)
            back = Back(value, self.root.new(), root.strength + max(self.root.customers - 1, 0), root.discount)
            fresh = draw_tables(self.customers[part], np.log(d * np.maximum(gamma, 1e-300))[of], back, self.stirling, self.rng)
            more = (fresh - mine).astype(float)
            self.tables[part] = fresh
            self.total = self.total + np.bincount(c, weights=more, minlength=len(self.total))
            self.parent_customers = self.parent_customers + np.bincount(w, weights=more, minlength=len(self.parent_customers)).astype(np.int64)


def seat(level: Level, root: Root, hot: dict[int, tuple[int, int]], seed: int, number: int):
    """One bucket, one round: sweeps over its contexts; counts of tables for the word buckets."""

    def run(seats: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = seats["bucket"][0].as_py()
        c, w, customers, ones_c, ones_w, peer_of, ask, is_hot, hot_words = unpack(seats["payload"][0].as_py())
        ones_c, ones_w, n = from_planes(ones_c).astype(np.int64), from_planes(ones_w).astype(np.int64), len(peer_of)
        parent = np.zeros((2, n), np.int64)
        parent[:, ask] = _answers(answers, PARENT)[0][1]
        before = _answers(answers, TABLES)
        tables = before[-1][1][0] if before else np.ones(len(c), np.int64)
        total = (ones_c + np.bincount(c, weights=tables, minlength=n)).astype(float)
        own = total.copy()
        for i, x in zip(is_hot, hot_words.view(np.int64), strict=True):
            total[i] = hot[int(x)][1]
        state = Seating(level, root, c, w, customers, tables, total, *parent, np.random.default_rng([seed, number, bucket, 0]))
        for _ in range(SWEEPS):
            state.sweep()
        told = (ones_w + np.bincount(w, weights=state.tables, minlength=n).astype(np.int64))[ask]
        edges = np.searchsorted(peer_of[ask], np.arange(int(peer_of.max(initial=0)) + 2))
        rows = [(ASK, bucket, int(q), pack(ints(told[edges[q] : edges[q + 1]])), None, number, None) for q in np.flatnonzero(np.diff(edges))]
        own += state.total - total
        rows += [(HOT, bucket, None, None, int(x), 0, int(own[i])) for i, x in zip(is_hot, hot_words.view(np.int64), strict=True)]
        rows.append((TABLES, bucket, 0, pack(ints(state.tables)), None, number, None))
        return _rows(rows)

    return run


SUMS = "kind int, bucket int, id long, known double, log_count double, log_score double, payload binary"


def _sums(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary())
    return pa.table({x.split()[0]: pa.array([r[i] for r in rows], k) for i, (x, k) in enumerate(zip(SUMS.split(", "), kinds, strict=True))})


def score(level: Level, roots: dict[int, Root], hots: dict[int, dict[int, tuple[int, int]]], n_buckets: int, seed: int):
    """One bucket: what its occurrences add to their documents' sums, by batch, and what a fat
    pair's occurrences add each."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = state["bucket"][0].as_py()
        steps, learned, size, d, times, source, batches, ask, customers, is_hot, hot_words, fat, names = (from_planes(x).astype(np.int64) if x.ndim == 2 else x for x in unpack(state["payload"][0].as_py()))
        (c, w), n = pairs_of(steps), len(customers)
        known = np.zeros(n, np.int64)
        known[ask] = _answers(answers, COUNTS)[0][1][0]
        parents, tables_of = dict(_answers(answers, PARENT)), dict(_answers(answers, TABLES))
        many = np.flatnonzero(learned > 1)
        mean = np.zeros(len(w))
        for number, root in roots.items():
            tables = np.minimum(learned, 1)
            if number in tables_of:
                tables[many] = tables_of[number][0]
            total, full = np.bincount(c, weights=tables, minlength=n), customers.astype(float)
            for i, x in zip(is_hot, hot_words.view(np.int64), strict=True):
                full[i], total[i] = hots[number][int(x)]
            parent = np.zeros((2, n), np.int64)
            parent[:, ask] = parents[number]
            seating = Seating(level, root, c[many], w[many], learned[many], tables[many], total, *parent, np.random.default_rng([seed, number, bucket, 2]))
            for _ in range(SWEEPS):
                seating.sweep()
                tables[many] = seating.tables
                back = root.probability(seating.parent_customers, seating.parent_tables)
                mean += (learned - level.discount * tables + (level.strength + level.discount * seating.total[c]) * back[w]) / (level.strength + full[c])
        score = np.log10(mean / (len(roots) * SWEEPS))
        seen, counts = (known[w] > 0).astype(float), np.log10(known[w] + 1.0)
        rows = [(FATS, None, int(k), float(seen[i]), float(counts[i]), float(score[i]), None) for i, k in zip(fat, names, strict=True)]
        # entries of a batch together, then its documents
        width = int(d.max(initial=0)) + 1
        at, index = np.unique(source * width + d, return_inverse=True)
        values = [np.bincount(index, weights=np.repeat(x, size) * times, minlength=len(at)) for x in (seen, counts / BASE_UNIT, -score / SCORE_UNIT)]
        edges = np.searchsorted(at // width, np.arange(len(batches) + 1))
        for b, lo, hi in zip(batches.tolist(), edges[:-1], edges[1:], strict=True):
            if hi > lo:
                rows.append((PACKED, home(b, n_buckets), b, None, None, None, pack(ints(at[lo:hi] % width), *(ints(np.round(v[lo:hi])) for v in values))))
        return _sums(rows)

    return run


def fat_sums(n_buckets: int):
    """Rows of fat pairs in a batch, with what each occurrence adds, to sums by document."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("n", "known", "log_count", "log_score")]
            rows = []
            for b, known, count, value, payload in zip(*cols, batch.column("payload"), strict=True):
                d, times = (from_planes(x).astype(np.int64) for x in unpack(payload.as_py()))
                rows.append((PACKED, home(b, n_buckets), b, None, None, None, pack(ints(d), *(ints(np.round(x * times)) for x in (known, count / BASE_UNIT, -value / SCORE_UNIT)))))
            yield from _sums(rows).to_batches()

    return run


def total(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """The batches of a bucket: their documents' sums."""
    by_batch: dict[int, list] = {}
    for b, payload in zip(sums["id"].to_pylist(), sums["payload"], strict=True):
        by_batch.setdefault(b, []).append(payload)
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], *([np.zeros(0)] for _ in range(3))
    for b, payload in zip(docs["id"].to_pylist(), docs["payload"], strict=True):
        keys, n_tokens = unpack(payload.as_py())
        values = np.zeros((3, len(keys)))
        for x in by_batch.get(b, []):
            d, *parts = (from_planes(y) for y in unpack(x.as_py()))
            for k, y in enumerate(parts):
                values[k] += np.bincount(d.astype(np.int64), weights=y.astype(float), minlength=len(keys))
        for to, x in zip(out, (keys, from_planes(n_tokens).astype(np.int64), values[0], values[1] * BASE_UNIT, -values[2] * SCORE_UNIT), strict=True):
            to.append(x)
    keys, n_tokens, known, counts, scores = (np.concatenate(x) for x in out)
    return pa.table({"key": keys, "n_tokens": n_tokens, "n_known": np.round(known).astype(np.int64), "log_counts": counts, "score": scores})


def _bucketed(df: DataFrame, n: int) -> tuple[str, DataFrame]:
    """df as a table bucketed by bucket, a folder for each kind: read later without a shuffle."""
    name = f"lm_{uuid.uuid4().hex}"
    df.write.partitionBy("kind").bucketBy(n, "bucket").option("compression", "zstd").saveAsTable(name)
    return name, df.sparkSession.table(name)


def _discount(ones: int, twos: int) -> float:
    return float(min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.8))


def score_texts(docs: DataFrame, train, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 11) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id,
    text); train: a condition on docs that picks the rows to learn from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"), F.xxhash64("doc_id", "text").alias("key"))
    parts = rows.select("key", "train", "text")
    seen = cut(parts.mapInArrow(frequent, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")), "lm-frequent")
    tokens_seen = seen.where("context = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not tokens_seen:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    n = max(1, -(-tokens_seen // BUCKET_TOKENS))
    top = seen.where("context <> -1").orderBy(F.desc("n"), "context").limit(COMMON).toArrow()  # bounded
    names, often = top["context"].to_numpy().view(np.uint64), top["n"].to_numpy()
    common, hot_words = np.sort(names), np.sort(names[often * (4 * n) >= tokens_seen])
    dealt = parts.mapInArrow(deal(n, common, hot_words), DEALT)
    buckets = min(n, shuffle_partitions(spark))
    held_name, held = _bucketed(dealt.groupBy("bucket").applyInArrow(build(n, common, hot_words), ROWS), buckets)
    kind = lambda df, k: df.where(F.col("kind") == k)
    level = Level(_discount(*kind(held, TOTAL).agg(F.sum("n"), F.sum("t")).first()), STRENGTH)
    split = kind(held, HOT).groupBy("id").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    hot = {r["id"]: (r["n"], r["t"]) for r in split.collect()}  # 4 * n rows at most, and COMMON
    customers_of = {i: x[0] for i, x in hot.items()}
    lists_name, lists = _bucketed(kind(held, ASK).groupBy("peer").applyInArrow(first_answers, ROWS), buckets)
    train_tokens, vocabulary = kind(lists, TOTAL).agg(F.sum("n"), F.sum("t")).first()
    directory, state, seats = kind(lists, DIRECTORY), kind(held, STATE), kind(held, SEATS)
    told = kind(held, ASK).select("peer", "bucket", "payload").where(F.lit(False))
    root_level, tables_before = Level(0.5, STRENGTH_ROOT), vocabulary
    rng = np.random.default_rng([seed, 7])
    roots, hots, answers, tables = {}, {}, kind(lists, COUNTS), None
    for number in range(burn_in + samples):
        grouped = directory.groupBy("bucket").cogroup(told.withColumnRenamed("bucket", "from").withColumnRenamed("peer", "bucket").groupBy("bucket"))
        gamma = float(rng.gamma(root_level.strength / root_level.discount + tables_before))
        answered = cut(grouped.applyInArrow(_renamed(parent_answers(root_level, vocabulary, gamma, seed, number)), ROWS), "lm-parent")
        customers, tables_before = kind(answered, TOTAL).agg(F.sum("n"), F.sum("t")).first()
        root = Root(root_level, customers, tables_before, vocabulary)
        root_level = Level(_discount(*kind(answered, HOT).agg(F.sum("n"), F.sum("t")).first()), STRENGTH_ROOT)
        parent = kind(answered, PARENT)
        given = parent if tables is None else parent.unionByName(tables)
        if number >= burn_in:
            roots[number], hots[number] = root, hot
            answers = answers.unionByName(given)
        if number == burn_in + samples - 1:
            break
        seated = cut(seats.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(seat(level, root, hot, seed, number + 1), ROWS), "lm-seats")
        hot = {r["id"]: (customers_of[r["id"]], r["t"]) for r in kind(seated, HOT).groupBy("id").agg(F.sum("t").alias("t")).collect()}
        told, tables = kind(seated, ASK).select("peer", "bucket", "payload"), kind(seated, TABLES)
    scored = cut(state.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score(level, roots, hots, n, seed), SUMS), "lm-scores")
    fats = kind(held, KEPT).select("id", "n", "payload").join(scored.where(F.col("kind") == FATS).select("id", "known", "log_count", "log_score"), "id")
    sums = scored.where(F.col("kind") == PACKED).unionByName(fats.mapInArrow(fat_sums(n), SUMS)).select("bucket", "id", "payload")
    listed = kind(held, LISTED).select("bucket", "id", "payload")
    sums = listed.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(total, "key long, n_tokens long, n_known long, log_counts double, score double")
    sums = cut(sums.dropDuplicates(["key"]), "lm-sums")  # equal rows have equal sums
    for name in (held_name, lists_name):
        spark.sql(f"DROP TABLE {name}")
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(math.log10(train_tokens + vocabulary + 1))
    return rows.select("doc_id", "key").join(sums, "key").select("doc_id", "n_tokens", "n_known", F.lit(int(train_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _renamed(answer):
    """told's columns as parent_answers reads them: bucket is who told."""
    return lambda directory, told: answer(directory, told.rename_columns(["bucket" if c == "from" else "word_bucket" if c == "bucket" else c for c in told.column_names]))
