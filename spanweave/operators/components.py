"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.xxhash64("a", "b") / 4294967296.0).cast("long")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of edges (a, b: longs).

    Alternating large and small stars: each round hooks neighbours to the least node in reach,
    so depth shrinks by powers, however long the chains. Minima are taken before the shuffle and
    the joins back to a hub are plain equi-joins that Spark can split. Each round is written to
    the shared folder; null ends and loops are dropped."""
    found = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(found)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        # large star: larger neighbours move to the least of a node's neighbours and itself
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        found = cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _state(found)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = found.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
