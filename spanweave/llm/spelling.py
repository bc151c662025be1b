"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

The vocabulary (frequent words with their counts) is put into blocked Bloom filters, a shard for
each word length, which are broadcast. Each word's deletions are probed in the shard of the length
below its own, its replacements by a greater letter in the shard of its own length, so that each pair is found from one
side. An edit is probed by its rolling hash, which follows from the word's without the edited
text. Only edits that a filter holds are shuffled, as a few numbers each, to an equi-join
with the vocabulary, and the joined pair of words is compared exactly, which removes all false positives.
An edit that is a word is always held, so no pair is lost.

Bounds: a pack of filters, which is what is broadcast and passes through the driver, has at most
``PACK_BYTES``. Shards that together need more go to several packs, a shard that alone needs more is split by
hash, and words are probed against each pack in turn. A word has at most as many partners as edits; nothing is
grouped but by word. Words of any length are handled in slices of ``SLICE`` edits.

Nulls: a null text has no words, a null id counts as the empty text. Ties of the count go to the first
word in code-point order. No words, or an empty table, give no rows. Other columns are left aside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ascii_lower, cut

#: The letters of a word, after A to Z are lower-cased; the least length and count of a word;
#: how much more frequent a form is; one in so many of a document's words is damaged.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGED = 6, 5, 5, 199

PACK_BYTES = 32 << 20
#: Bits of a filter for each word, and the bits that each word sets within one block of 64.
BITS, PROBES = 24, 5
SLICE = 1 << 20
#: The rolling hash: sum of code times BASE ** place, modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
_BACK = pow(BASE, -1, 1 << 64)


def words(docs: DataFrame) -> DataFrame:
    """word, n of each word of docs (doc_id, text): maximal runs of letters, A to Z lower-cased; where DAMAGED divides
    the crc32 of id, colon and run, the run has lost one letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{LEAST_LENGTH},}})"), 1)).alias("run"))
    runs = runs.select(ascii_lower(F.col("run")).alias("run"), F.crc32(F.concat("id", F.lit(":"), ascii_lower(F.col("run"))).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGED == 0, short).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in texts and a matrix of codes for each length, at most SLICE codes or one text in each."""
    lengths = np.array([len(t) for t in texts])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        rows = max(1, SLICE // max(int(length) * len(LETTERS), 1))
        for part in np.split(at, range(rows, len(at), rows)):
            yield part, np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), -1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(texts: list[str]) -> np.ndarray:
    """The hash of each text."""
    out = np.zeros(len(texts), np.uint64)
    for at, codes in _by_length(texts):
        out[at] = (codes.astype(np.uint64) * _powers(codes.shape[1], BASE)).sum(axis=1, dtype=np.uint64)
    return out


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = rolling(batch.column(0).to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], ["word", "n", "key"])


def _place(key: np.ndarray, parts: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of a shard, the block in it and the bits in the block that stand for each key."""
    h = _mixed(key)
    bits = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    high = h >> np.uint64(32)
    return high % np.uint64(parts), (high // np.uint64(parts)) % np.uint64(blocks), bits


def _shards(sizes: dict[int, int], pack_bytes: int) -> dict[int, tuple[int, int]]:
    """Length to (parts, blocks of 64 bits in each part)."""
    found = {}
    for length, n in sizes.items():
        blocks = max(1, -(-n * BITS // 64))
        parts = -(-blocks * 8 // pack_bytes)
        found[length] = (parts, -(-blocks // parts))
    return found


def _packs(shards: dict[int, tuple[int, int]], pack_bytes: int) -> list[dict[tuple[int, int], int]]:
    """Packs of (length, part) to the first block in the pack, each pack within its bytes."""
    packs, room = [], 0
    for length, (parts, blocks) in sorted(shards.items()):
        for part in range(parts):
            if not packs or room < blocks:
                packs.append({})
                room = pack_bytes // 8
            packs[-1][length, part] = pack_bytes // 8 - room
            room -= blocks
    return packs


def _set_bits(shards: dict, pack: dict) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, key = (np.asarray(c) for c in batch.columns)
            for (n, part), base in pack.items():
                own = key[length == n].view(np.uint64)
                if len(own):
                    of, block, bits = _place(own, *shards[n])
                    here = of == part
                    yield pa.RecordBatch.from_arrays([pa.array((block[here] + np.uint64(base)).view(np.int64)), pa.array(bits[here].view(np.int64))], ["block", "bits"])

    return run


def _filter(vocabulary: DataFrame, shards: dict, pack: dict) -> np.ndarray:
    """The blocks of a pack: set in tasks, united by a grouped OR, at most PACK_BYTES to the driver."""
    lengths = sorted({n for n, _ in pack})
    keys = vocabulary.select(F.length("word").alias("length"), "key").where(F.col("length").isin(lengths))
    rows = keys.mapInArrow(_set_bits(shards, pack), "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    n, part = max(pack, key=pack.get)
    found = np.zeros(pack[n, part] + shards[n][1], np.uint64)
    found[np.asarray(rows.column(0))] = np.asarray(rows.column(1)).view(np.uint64)
    return found


def _held(filters: np.ndarray, shards: dict, pack: dict, length: int, key: np.ndarray) -> np.ndarray:
    """Which keys the pack's filters of a length hold."""
    if length not in shards or not any((length, p) in pack for p in range(shards[length][0])):
        return np.zeros(len(key), bool)
    part, block, bits = _place(key, *shards[length])
    base = np.array([pack.get((length, p), -1) for p in range(shards[length][0])])[part.astype(np.int64)]
    at = np.where(base >= 0, base + block.astype(np.int64), 0)
    return (base >= 0) & (filters[at] & bits == bits)


def _edits(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length: (length, row, place, letter, hash) of their deletions (letter 0), one of each run of equal
    letters, and of their replacements by greater letters."""
    n = codes.shape[1]
    powers, wide = _powers(n, BASE), codes.astype(np.uint64)
    terms = wide * powers
    whole = terms.sum(axis=1, dtype=np.uint64)
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    last = np.ones(codes.shape, bool)
    last[:, :-1] = codes[:, :-1] != codes[:, 1:]
    row, at = np.nonzero(last)
    before = upto[row, at] - terms[row, at]
    yield n - 1, row, at, np.zeros(len(row), np.int64), before + (whole[row] - upto[row, at]) * np.uint64(_BACK)
    for letter in map(ord, LETTERS):
        row, at = np.nonzero(codes < letter)
        yield n, row, at, np.full(len(row), letter), whole[row] + (np.uint64(letter) - wide[row, at]) * powers[at]


def _probe(shared, shards: dict, pack: dict):
    near = {n + d for n, _ in pack for d in (0, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            texts, key = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            for rows, codes in _by_length(texts):
                if codes.shape[1] in near:
                    for length, row, at, letter, edited in _edits(codes):
                        held = _held(filters, shards, pack, length, edited)
                        columns = [key[rows[row[held]]], edited[held].view(np.int64), at[held].astype(np.int64), letter[held].astype(np.int64)]
                        if len(columns[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "edited", "at", "letter"])

    return run


def near_pairs(vocabulary: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """a, n_a, b, n_b: each pair of words one edit apart, once. vocabulary: word, n, key (the rolling hash)."""
    spark = vocabulary.sparkSession
    sizes = {r["length"]: r["count"] for r in vocabulary.groupBy(F.length("word").alias("length")).count().collect()}  # a row for each length
    shards = _shards(sizes, pack_bytes)
    found = spark.createDataFrame([], "key long, edited long, at long, letter long")
    for pack in _packs(shards, pack_bytes):
        shared = spark.sparkContext.broadcast(_filter(vocabulary, shards, pack))
        found = found.unionByName(vocabulary.select("word", "key").mapInArrow(_probe(shared, shards, pack), "key long, edited long, at long, letter long"))
    other = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("key").alias("edited"))
    own = vocabulary.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "key")
    met = found.join(other, "edited").join(own, "key")
    at = F.col("at").cast("int")
    text = F.concat(F.substring("a", F.lit(1), at), F.when(F.col("letter") > 0, _letter(F.col("letter"))).otherwise(""), F.substring("a", at + 2, F.length("a")))
    return met.where(text == F.col("b")).select("a", "n_a", "b", "n_b")


def _letter(code: Column) -> Column:
    """The letter of a code: a place in the fixed list of letters."""
    place = F.when(code < 0xC0, code - ord("a")).otherwise(code - 0xC0 + len(LOWER))
    return F.substring(F.lit(LETTERS), (place + 1).cast("int"), F.lit(1))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for each word with a form: forms are followed to the last, twice as far in each round. A form is RATIO
    times as frequent as its word, so that chains are as short as the logarithm of the counts."""
    found = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        found = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return found


def variants(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """For each word of docs (doc_id, text): word, n, n_near (words one edit apart), form (the most frequent of them, if
    RATIO times as frequent), form_n, and root, the last of the forms from word on."""
    counted = cut(words(docs.select("doc_id", "text")).mapInArrow(_with_keys, "word string, n long, key long"), "spelling-words")
    pairs = cut(near_pairs(counted, pack_bytes), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = counted.join(best, "word", "left")
    chosen = -F.col("best.less") >= RATIO * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
