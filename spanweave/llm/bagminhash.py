"""MinHash near-dedup by BagMinHash signatures.

A document is a bag of runs of five words. Every run of words carries Poisson processes over the
axis of its weight, one for each box of a dyadic division (0 to 1, 1 to 2, 2 to 4, ...); a point
has a time, a signature slot and a place on the axis, drawn from a hash of the run, the box and
the point's number, and counts for a document if its place is below the run's count there. A
slot keeps its earliest point, so two signatures agree in a slot with a probability equal to the
weighted Jaccard similarity of the bags. Only points up to a time limit are drawn, which all
slots are likely to have met; where some are not, the limit doubles.

Equal bags form a class, and one of its rows stands for it. Bands of the signatures give buckets.
First each member of a bucket is verified against the bucket's center (a star, not all pairs) and
components are formed. In buckets that still hold several components, blocks of members are
verified against each other at once (a product of 0-1 matrices gives all overlaps), so that only
links between components leave the task.
Verification is the exact weighted Jaccard similarity of both bags. No bucket is capped.

Edge cases: texts of one to four words have one run, the whole text; texts without words (null
too) are one class; repeated rows are equal; null ids are kept (a class id is the least id of the
group, null if it has none); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused
from .components import components, open_members, stars
from .text_arrays import SPACED, Words, chunks, gram_hashes, mix

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
#: Agreeing slots that a star's pair needs to be verified; at similarity 0.8 one in 100,000 has fewer.
LEAST_AGREEING = 48
BLOCK = 1024
COLUMNS = 4096
_LOW48 = np.uint64((1 << 48) - 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, run (48-bit hash), count, sorted by document and run."""
    hashes, n = words.hashes(), len(words.counts)
    grams = gram_hashes(hashes, k)
    inside = np.flatnonzero(np.arange(len(grams)) + k <= np.repeat(words.first[1:], words.counts)[: len(grams)])
    docs, values = [words.doc[inside]], [grams[inside]]
    for d in np.flatnonzero((words.counts > 0) & (words.counts < k)):
        docs.append(np.array([d]))
        values.append(gram_hashes(hashes[words.first[d] : words.first[d + 1]], int(words.counts[d])))
    docs, values = np.concatenate(docs), np.concatenate(values) & _LOW48
    assert n <= 1 << 16
    both = np.sort((docs.astype(np.uint64) << np.uint64(48)) | values)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    return (both[at] >> np.uint64(48)).astype(np.int64), both[at] & _LOW48, np.diff(np.append(at, len(both)))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(doc: np.ndarray, run: np.ndarray, count: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """The winning point of each slot (a hash; 0 for documents without words)."""
    weight = np.bincount(doc, weights=count, minlength=n_docs)
    out = np.zeros(n_docs * slots, np.uint64)
    todo, limit = weight > 0, (np.log(slots) + 6) / np.maximum(weight, 1)
    # boxes: 0 covers [0, 1), j covers [2^(j-1), 2^j)
    top = np.ceil(np.log2(count)).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(doc)), top)
    box = np.arange(len(owner)) - np.repeat(np.cumsum(top) - top, top)
    low, length = np.where(box > 0, 1 << np.maximum(box - 1, 0), 0), np.where(box > 1, 1 << np.maximum(box - 1, 0), 1)
    seed = mix(run[owner] + box.astype(np.uint64) * _GOLD)
    while todo.any():
        best = np.full(n_docs * slots, np.inf)
        live = np.flatnonzero(todo[doc[owner]])
        time, number = np.zeros(len(live)), np.zeros(len(live), np.int64)
        points = []
        while len(live):
            own, rate = owner[live], slots * length[live]
            want = (rate * (limit[doc[own]] - time) * 1.1).astype(np.int64) + 1
            which = np.repeat(np.arange(len(live)), want)
            step = np.arange(len(which)) - np.repeat(np.cumsum(want) - want, want)
            hashed = mix(seed[live][which] + (number[which] + step + 1).astype(np.uint64) * _GOLD)
            gaps = -np.log1p(-_unit(hashed)) / rate[which]
            sums = np.cumsum(gaps)
            begin = np.cumsum(want) - want
            when = sums - (sums[begin] - gaps[begin])[which] + time[which]
            last = np.cumsum(want) - 1
            second = mix(hashed ^ _GOLD)
            place = low[live][which] + ((second >> np.uint64(32)).astype(np.float64) * 2.0**-32 * length[live][which]).astype(np.int64)
            good = (when <= limit[doc[own]][which]) & (place < count[own][which])
            key = doc[own][which[good]] * slots + (second[good] % np.uint64(slots)).astype(np.int64)
            points.append((key, when[good], hashed[good]))
            np.minimum.at(best, key, when[good])
            on = when[last] <= limit[doc[own]]
            live, time, number = live[on], when[last][on], (number + want)[on]
        for key, when, hashed in points:
            wins = when == best[key]
            out[key[wins]] = hashed[wins]
        missing = np.isinf(best).reshape(n_docs, slots).any(axis=1) & todo
        todo, limit = missing, np.where(missing, limit * 2, limit)
    return out.reshape(n_docs, slots)


def _small(column: pa.Array, most: int = 1 << 16):
    """Chunks of at most so many documents."""
    for at in range(0, len(column), most):
        for lo, hi, words in chunks(column.slice(at, most), SPACED, lower=True):
            yield at + lo, at + hi, words


def _bag_keys(doc: np.ndarray, run: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """A hash of each document's whole bag (a sum over its runs, so that order is of no account)."""
    each = mix(run + count.astype(np.uint64) * _GOLD)
    total = np.zeros(n_docs, np.uint64)
    np.add.at(total, doc, each)
    return mix(total).view(np.int64)


SIGNED = "key long, node long, weight long, slots binary, bands array<long>"


def sign(batches):
    """(key, text) rows to the bag's key, its size, 16 bits of each slot, and band hashes."""
    for batch in batches:
        for lo, hi, words in _small(batch.column("text")):
            n = hi - lo
            doc, run, count = bags(words)
            nodes = _bag_keys(doc, run, count, n)
            _, first, inverse = np.unique(nodes, return_index=True, return_inverse=True)
            mine = np.isin(doc, first)
            rank = np.zeros(n, np.int64)
            rank[first] = np.arange(len(first))
            points = signatures(rank[doc[mine]], run[mine], count[mine], len(first))
            band = points.reshape(len(first), BANDS, ROWS)
            salted = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
            for r in range(ROWS):
                salted = mix(salted + band[:, :, r])
            hashes = salted[inverse].view(np.int64)
            weight = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            slots = points.astype(np.uint16)[inverse]
            full = (weight > 0)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full[:, 0], BANDS, 0))]).astype(np.int32)), pa.array(hashes[full[:, 0]].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, n), pa.array(nodes), pa.array(weight), pa.array([s.tobytes() for s in slots], pa.binary()), lists], ["key", "node", "weight", "slots", "bands"])


def elements(batches):
    """(key, text) rows to the bag as sorted hashes, the second of equal runs apart from the first."""
    for batch in batches:
        for lo, hi, words in _small(batch.column("text")):
            doc, run, count = bags(words)
            at = np.repeat(np.arange(len(doc)), count)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            value = mix(run[at] + nth.astype(np.uint64) * _GOLD)
            order = np.lexsort((value, doc[at]))
            edges = np.searchsorted(doc[at][order], np.arange(hi - lo + 1))
            value = value[order]
            nodes = _bag_keys(doc, run, count, hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([value[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["node", "bag"])


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.sort(np.concatenate([a, b]))
    same = int((both[1:] == both[:-1]).sum())
    return same / max(1, len(both) - same)


def _bags_of(nodes: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """node, bag of each of the nodes, from one row of its class. rows: key, text."""
    needed = classes.join(nodes.distinct(), "node").select("key")
    return cut(rows.join(needed, "key").select("key", "text").mapInArrow(elements, "node long, bag binary").dropDuplicates(["node"]), "bags")


def _overlap(batches):
    for batch in batches:
        pairs = zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)
        out = [_jaccard(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def _verify(pairs: DataFrame, rows: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose bags are similar enough. rows: key, text."""
    found = _bags_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), rows, classes)
    bag = lambda end: found.select(F.col("node").alias(end), F.col("bag").alias(f"bag_{end}"))
    met = pairs.join(bag("a"), "a").join(bag("b"), "b").select("a", "b", "bag_a", "bag_b")
    return met.mapInArrow(_overlap, "a long, b long, similarity double").where(F.col("similarity") >= similarity)


def _shared(bags_: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sizes of the overlaps of bags low and bags high: products of 0-1 matrices, some columns at
    a time, over the elements that two bags have."""
    doc = np.repeat(np.arange(len(bags_)), [len(b) for b in bags_])
    _, column, n = np.unique(np.concatenate(bags_), return_inverse=True, return_counts=True)
    both = n[column] > 1
    doc, column = doc[both], (np.cumsum(n > 1) - 1)[column[both]]
    out = np.zeros((len(low), len(high)), np.float64)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    edges = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 1 + COLUMNS, COLUMNS))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        table = np.zeros((len(bags_), COLUMNS), np.float32)
        table[doc[part], column[part] - k * COLUMNS] = 1
        out += table[low] @ table[high].T
    return out


def _linked(similarity: float):
    """One pair of blocks of a bucket: links between labels, as few as unite what belongs together."""

    def run(table: pa.Table) -> pa.Table:
        node, label, block = (table[c].to_numpy() for c in ("node", "label", "block"))
        bags_ = [np.frombuffer(b.as_buffer(), np.uint64) for b in table["bag"]]
        size = np.array([len(b) for b in bags_])
        low = np.flatnonzero(block == table["low"][0].as_py())
        high = np.flatnonzero(block == table["high"][0].as_py())
        same = _shared(bags_, low, high)
        alike = same >= similarity * (size[low][:, None] + size[high][None, :] - same)
        i, j = np.nonzero(alike & (label[low][:, None] != label[high][None, :]))
        home = {x: x for x in label.tolist()}

        def find(x):
            while home[x] != x:
                home[x] = home[home[x]]
                x = home[x]
            return x

        links = []
        for x, y in zip(low[i].tolist(), high[j].tolist(), strict=True):
            a, b = find(label[x].item()), find(label[y].item())
            if a != b:
                home[a] = b
                links.append(sorted((node[x].item(), node[y].item())))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _across(members: DataFrame, bags_: DataFrame, similarity: float) -> DataFrame:
    """Links in buckets that hold several labels, found block against block."""
    order = Window.partitionBy("bucket").orderBy("node")
    placed = members.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
    last = placed.groupBy("bucket").agg(F.max("block").alias("last"))
    each = placed.join(last, "bucket").select("bucket", "node", "label", "block", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    each = each.select("bucket", "node", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return each.join(bags_, "node").groupBy("bucket", "low", "high").applyInArrow(_linked(similarity), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key (of the row), label, class_id, n_class: rows of one label are linked by similarity;
    class_id is their least doc_id."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    signed = rows.select("key", "text").mapInArrow(sign, SIGNED)
    signed = cut(signed, "signatures")
    classes = cut(signed.groupBy("node").agg(F.min(F.struct("key", "slots", "bands")).alias("one"), F.count(F.lit(1)).alias("copies")).select("node", "copies", "one.*"), "classes")
    members = cut(classes.select("node", F.col("copies").alias("weight"), F.explode("bands").alias("bucket")), "bands")
    slots = classes.select("node", "slots")
    near = lambda x, y: F.size(F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.substring(x, i * 2 + 1, 2) == F.substring(y, i * 2 + 1, 2))) >= LEAST_AGREEING
    spoke = lambda end: slots.select(F.col("node").alias(end), F.col("slots").alias(f"slots_{end}"))
    first = stars(members).join(spoke("a"), "a").join(spoke("b"), "b").where(near(F.col("slots_a"), F.col("slots_b"))).select("a", "b")
    texts = rows.select("key", "text")
    links = cut(_verify(cut(first, "pairs"), texts, classes, similarity), "links")
    labels = components(links)
    rest = cut(open_members(members.select("bucket", "node"), labels), "open")
    more = cut(_across(rest, _bags_of(rest.select("node"), texts, classes), similarity), "links")
    if not more.isEmpty():
        labels = components(links.select("a", "b").unionByName(more))
    ids = rows.select("key", "doc_id").join(signed.select("key", "node").distinct(), "key")
    tagged = ids.join(labels, "node", "left").select("doc_id", "key", F.coalesce("label", "node").alias("label"))
    named = tagged.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_class"))
    return tagged.join(named, "label").select("doc_id", "key", "label", "class_id", "n_class")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group, that of the least doc_id (then the least row key)."""
    found, key = near_duplicates(docs, similarity), unused(docs, "__key")
    kept = found.groupBy("label").agg(F.min(F.struct("doc_id", "key"))["key"].alias(key)).select(key)
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(kept, key).dropDuplicates([key]).select(*docs.columns)
