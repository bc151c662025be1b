"""Sharding by a hypergeometric communication matrix.

Rows are dealt to source partitions by a hash of their id. The driver draws, exactly and
from a seed, how many rows each partition sends to each shard (multivariate hypergeometric,
row by row, so that every shard gets its exact size), then each partition ranks its rows in
a random order and sends runs of ranks to the shards, and each shard ranks what arrived in a
second random order. The outcome is a uniform shuffle with exact shard sizes: counts are at
most one apart (law ``rows``). Both orders are hashes of the id and the seed, so a task that
runs again gives the same rows the same places.

Driver memory: the matrix has at most ``MAX_PARTITIONS`` rows. Nothing else is collected.

Edge cases: null text has size 1 and the crc of an empty text; null ids and repeated rows
are rows like others (ties of the hashes are broken by size and crc; rows equal in all
three are interchangeable); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ROWS_PER_PARTITION = 256
MAX_PARTITIONS = 65536


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows: partitions; columns: shards; row sums: counts; column sums: shard sizes."""
    total = sum(counts)
    left = np.full(n_shards, total // n_shards, np.int64)
    left[: total % n_shards] += 1
    rng, out = np.random.default_rng(seed), np.zeros((len(counts), n_shards), np.int64)
    for i, n in enumerate(counts):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


def shuffle_shards(docs: DataFrame, n_shards: int = 16, seed: int = 17, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    total = docs.count()
    parts = max(1, min(MAX_PARTITIONS, -(-total // rows_per_partition)))
    mixed = lambda salt: F.xxhash64(F.lit(seed * 4 + salt), "doc_id")
    rows = cut(rows.withColumn("part", F.pmod(mixed(0), F.lit(parts)).cast("int")), "shards-rows")
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # at most parts rows
    matrix = communication_matrix([counts.get(i, 0) for i in range(parts)], n_shards, seed)
    ends = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(matrix.cumsum(axis=1))], "part int, ends array<bigint>")
    order = lambda salt: (mixed(salt), "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order(1))) - 1)
    sent = ranked.join(F.broadcast(ends), "part")  # at most MAX_PARTITIONS rows
    sent = sent.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int"))
    bins = max(1, parts // n_shards)  # a shard's second order: bins by hash, then a rank in each
    sent = cut(sent.select("doc_id", "size", "text_crc32", "shard", F.pmod(mixed(2), F.lit(bins)).cast("int").alias("bin")), "shards-sent")
    sizes = sent.groupBy("shard", "bin").count()
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    slot = F.col("start") + F.row_number().over(Window.partitionBy("shard", "bin").orderBy(*order(3))) - 1
    return sent.join(F.broadcast(starts), ["shard", "bin"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
