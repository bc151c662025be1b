"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of hashed embeddings of itself and of its first 4, 5 and 6 bytes. Filters of
one to three words slide over the whole text, each keeps its maximum, and a logistic unit
reads the maxima. Training (Adagrad, from the words' log odds; gradients flow through the
maxima only) takes all labelled rows: they are dealt by a hash of their ids into parts of about ``PART`` rows, each part
learns from the model as it is so far, and what the parts changed is averaged by rows, entry by entry, over the parts that
changed it; ``ROUNDS`` such rounds. Log odds are counts over all parts. Scores are shifted to the share of toxic labels
among all training labels, and a threshold is calibrated for each language on a sixth of the rows, kept out of the fit,
by scores in steps of 1 / ``STEPS``. Scoring is one pass over all rows.

Edge cases: null or wordless texts get the score of a text without words; without labels of
both kinds every score is the share of toxic labels (0.5 without any). Several labels of one id
count as toxic if any is. Null ids and repeated rows are scored like others. Languages that
show rarely there use 0.5 as threshold. Other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .text_arrays import ALNUM, Words, chunks

PART, STEPS, BLOCK, LEAST = 5000, 10_000, 1 << 14, 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
ROUNDS, BATCH, RATE = (3, 2), 32, 0.08  # epochs of each round
PREFIXES = (None, 4, 5, 6)


@dataclass
class Model:
    embedding: np.ndarray | None = None
    filters: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    weights: np.ndarray | None = None
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def features(words: Words) -> np.ndarray:
    """Buckets of each word, a column for each kind of part."""
    return np.stack([((words.hashes(p) >> np.uint64(7 + i)) % np.uint64(BUCKETS)).astype(np.int32) for i, p in enumerate(PREFIXES)], axis=1)


def _slid(parts: list[np.ndarray], last: np.ndarray) -> np.ndarray:
    """Sum of parts[j] at word t + j; what lies beyond a document's end counts as nothing."""
    out = parts[0].copy()
    for j, p in enumerate(parts[1:], 1):
        shifted = np.zeros_like(p)
        shifted[:-j] = p[j:]
        out += np.where((np.arange(len(p)) + j <= last)[:, None], shifted, 0)
    return out


def _responses(model: Model, index: np.ndarray, table: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """For each width the filters' response at each word; table: vectors, index: of each word."""
    return [_slid([(table @ w[j])[index] for j in range(len(w))], last) for w in model.filters]


def pooled(model: Model, index: np.ndarray, table: np.ndarray, first: np.ndarray) -> np.ndarray:
    counts = np.diff(first)
    out = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
    if len(index):
        last = np.repeat(first[1:] - 1, counts)
        full = counts > 0
        out[full] = np.concatenate([np.maximum.reduceat(z, first[:-1][full], axis=0) for z in _responses(model, index, table, last)], axis=1)
    return np.maximum(out + model.bias, 0)


def score_words(model: Model, words: Words) -> np.ndarray:
    if model.embedding is None:
        return np.full(len(words.counts), 1 / (1 + np.exp(-model.shift)))
    hashes = words.hashes()
    _, at, index = np.unique(hashes, return_index=True, return_inverse=True)
    kept = object.__new__(Words)
    kept.data, kept.starts, kept.ends = words.data, words.starts[at], words.ends[at]
    table = model.embedding[features(kept)].sum(axis=1) if len(at) else np.zeros((0, DIM), np.float32)
    z = pooled(model, index, table, words.first).astype(np.float64) @ model.weights[:-1] + model.weights[-1] + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fresh(seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS) + 1))
    model.weights[-1] = 0
    return model


def values(model: Model) -> list[np.ndarray]:
    return [model.embedding, *model.filters, model.bias, model.weights]


def flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel().astype(np.float64) for x in arrays])


def unflat(vector: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([x.size for x in like])
    return [p.reshape(x.shape).astype(x.dtype) for p, x in zip(np.split(vector, ends[:-1]), like, strict=True)]


def _of(arrays: list[np.ndarray], model: Model) -> Model:
    return replace(model, embedding=arrays[0], filters=list(arrays[1:-2]), bias=arrays[-2], weights=arrays[-1])


def _parts_of(texts: pa.Array) -> list[np.ndarray]:
    seen = []
    for _, _, words in chunks(texts, ALNUM, lower=True):
        parts = features(words)
        seen += [parts[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    return seen


def fit(model: Model, past: list[np.ndarray], seen: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int) -> None:
    """Changes model and past, the sums of its squared gradients."""
    rng = np.random.default_rng(seed)

    def step(value, grad, at, where=slice(None)):
        past[at][where] += grad * grad
        value[where] -= RATE * grad / np.sqrt(past[at][where])

    for _ in range(epochs):
        order = rng.permutation(len(seen))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            parts, counts = np.concatenate([seen[i] for i in rows]), np.array([len(seen[i]) for i in rows])
            first = np.concatenate([[0], np.cumsum(counts)])
            vectors = model.embedding[parts].sum(axis=1)
            last = np.repeat(first[1:] - 1, counts)
            zs = _responses(model, np.arange(len(parts)), vectors, last)
            best = np.zeros((len(rows), len(WIDTHS), FILTERS), np.int64)
            top = np.zeros((len(rows), len(WIDTHS), FILTERS), np.float32)
            for d in np.flatnonzero(counts):
                for k, z in enumerate(zs):
                    best[d, k] = first[d] + z[first[d] : first[d + 1]].argmax(axis=0)
                    top[d, k] = z[best[d, k], np.arange(FILTERS)]
            flat = np.maximum(top.reshape(len(rows), -1) + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(flat @ model.weights[:-1] + model.weights[-1], -50, 50)))
            err = (p - labels[rows]) / len(rows)
            d_flat = (err[:, None] * model.weights[:-1]) * (flat > 0)
            step(model.weights, np.append(err @ flat, err.sum()) + 1e-4 * np.append(model.weights[:-1], 0), -1)
            step(model.bias, d_flat.sum(axis=0).astype(np.float32), -2)
            d_top = d_flat.reshape(top.shape).astype(np.float32)
            where, what = [], []
            for k, w in enumerate(model.filters):
                d_w = np.zeros_like(w)
                for j in range(len(w)):
                    at = best[:, k] + j
                    live = (at < first[1:, None]) & (d_top[:, k] != 0)
                    docs, f = np.nonzero(live)
                    x, g = vectors[at[docs, f]], d_top[docs, k, f][:, None]
                    np.add.at(d_w[j].T, f, x * g)
                    where.append(at[docs, f])
                    what.append(g * w[j].T[f])
                step(w, d_w, 1 + k)
            where, what = np.concatenate(where), np.concatenate(what)
            buckets, inverse = np.unique(parts[where], return_inverse=True)
            grads = np.zeros((len(buckets), DIM), np.float32)
            np.add.at(grads, inverse.reshape(len(where), -1), what[:, None, :])
            step(model.embedding, grads, 0, buckets)


def _lean(model: Model, counts: np.ndarray, n: np.ndarray) -> None:
    """Start from what single words say: the first dimension of each bucket becomes its shrunken
    log odds of a toxic document, which the first filter of each width reads. counts: documents of each label with a
    bucket; n: documents of each label."""
    n = n[:, None] + 1.0
    odds = np.log((counts[1] + 0.5) / n[1]) - np.log((counts[0] + 0.5) / n[0])
    model.embedding[:, 0] = np.clip(odds * counts.sum(axis=0) / (counts.sum(axis=0) + 4), -3, 3) / len(PREFIXES)
    for k, w in enumerate(model.filters):
        w[0, :, 0], w[1:, :, 0] = np.eye(DIM)[0], 0
        model.weights[k * FILTERS] = 1


def score_column(model: Model, column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(score_words(model, words) for _, _, words in chunks(column, ALNUM, lower=True))])


def calibrated(table: pa.Table) -> pa.Table:
    """One language's threshold of the best F1 (the middle of the best gap). table: lang, step, n, toxic, low, high: rows, toxic
    ones and scores of each step of scores."""
    rows = table.sort_by([("step", "descending")])
    n, y, low, high = (rows[c].to_numpy().astype(float) for c in ("n", "toxic", "low", "high"))
    if min(y.sum(), (n - y).sum()) < LEAST:
        return pa.table({"lang": pa.array([], pa.string()), "threshold": pa.array([], pa.float64())})
    i = int(np.argmax(2 * np.cumsum(y) / (np.cumsum(n) + y.sum())))
    return pa.table({"lang": rows["lang"].slice(0, 1), "threshold": pa.array([(low[i] + (high[i + 1] if i + 1 < len(n) else 0)) / 2])})


def _blocks(vector: np.ndarray, part: int) -> pa.Table:
    pieces = [vector[i : i + BLOCK] for i in range(0, len(vector), BLOCK)]
    return pa.table({"part": pa.array([part] * len(pieces), pa.int64()), "block": pa.array(range(len(pieces)), pa.int64()), "data": pa.array([x.tobytes() for x in pieces], pa.binary())})


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(1)
    for data in table["data"]:
        total = total + np.frombuffer(data.as_py())
    return pa.table({"part": pa.array([table["part"][0].as_py() // 64], pa.int64()), "block": table["block"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})


def _total(rows: DataFrame, run, parts: int) -> np.ndarray:
    """The sum over all parts of what run makes of a part: vectors of a fixed length, added block by block, 64 at a time."""
    schema = "part long, block long, data binary"
    found = rows.groupBy("part").applyInArrow(run, schema)
    while parts > 1:
        found, parts = found.groupBy("block", F.floor(F.col("part") / 64)).applyInArrow(lambda _, t: _summed(t), schema), -(-parts // 64)
    return np.concatenate([np.frombuffer(r["data"]) for r in found.orderBy("block").collect()])


def _counted(table: pa.Table) -> pa.Table:
    counts, n = np.zeros((2, BUCKETS)), np.zeros(2)
    toxic = table["toxic"].to_numpy()
    for parts, y in zip(_parts_of(table["text"].combine_chunks()), toxic, strict=True):
        counts[int(y), np.unique(parts)] += 1
        n[int(y)] += 1
    return _blocks(np.concatenate([counts.ravel(), n]), table["part"][0].as_py())


def _learned(shared, epochs: int, number: int):
    """What a part changes in the model and its sums of squares, and where, times its rows."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("doc_id")
        model, past = shared.value
        before, before_past = flat(values(model)), flat(past)
        model, past = _of([x.copy() for x in values(model)], model), [x.copy() for x in past]
        part = rows["part"][0].as_py()
        fit(model, past, _parts_of(rows["text"].combine_chunks()), rows["toxic"].to_numpy().astype(float), epochs, 5 + 1000 * number + part)
        more = flat(past) - before_past
        return _blocks(len(rows) * np.concatenate([(flat(values(model)) - before) * (more > 0), more, more > 0]), part)

    return run


def train(docs: DataFrame, labels: DataFrame, part: int = PART) -> Model:
    """docs: doc_id, text, lang. labels: doc_id, toxic; the rows to learn from and no others, all of them.

    Of several rows of an id the one whose text has the least hash counts. Tasks hold a part of the rows at a time; the driver
    gets sums of the model's fixed size."""
    spark = docs.sparkSession
    flags = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n, positive = flags.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if not 0 < positive < n:
        return Model(shift=prior)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(flags, "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "lang", "toxic")).alias("one"))
    parts = -(-n // part)
    held = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(6)) == 0
    one = cut(one.select("doc_id", "one.text", "one.lang", "one.toxic", held.alias("held"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")), "toxicity-rows")
    known, toxic = one.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    kept = one.where("not held").select("part", "doc_id", "text", "toxic")
    kept_known, kept_toxic = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < kept_toxic < kept_known:
        return Model(shift=prior)
    counts = _total(kept, _counted, parts)
    model = fresh()
    _lean(model, counts[:-2].reshape(2, BUCKETS), counts[-2:])
    past = [np.full_like(x, 1e-2) for x in values(model)]
    for number, epochs in enumerate(ROUNDS):
        shared = spark.sparkContext.broadcast((model, past))
        change, more, times = np.split(_total(kept, _learned(shared, epochs, number), parts), 3)
        times = np.maximum(times, 1)
        model, past = _of(unflat(flat(values(model)) + change / times, values(model)), model), unflat(flat(past) + more / times, past)
        shared.destroy()
    model.shift = float(prior - np.log((toxic + 0.5) / (known - toxic + 0.5)))
    scored = with_scores(one.where("held"), model, keep=["lang", "toxic"])
    steps = scored.groupBy(F.coalesce("lang", F.lit("None")).alias("lang"), F.floor(F.col("score") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"), F.min("score").alias("low"), F.max("score").alias("high"))
    model.thresholds = {r.lang: r.threshold for r in steps.groupBy("lang").applyInArrow(calibrated, "lang string, threshold double").orderBy("lang").collect()}
    return model


def with_scores(docs: DataFrame, model: Model, score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all by default) and one more, the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(score_column(shared.value, batch.column("text")))], [*keep, score])

    return docs.mapInArrow(add, docs.select(*keep, F.lit(0.0).alias(score)).schema)


def rejects(model: Model, score: str = "score"):
    """True where a scored row reaches the threshold of its language."""
    limit = F.lit(0.5)
    for lang, t in model.thresholds.items():
        limit = F.when(F.coalesce(F.col("lang"), F.lit("None")) == lang, t).otherwise(limit)
    return F.col(score) >= limit
