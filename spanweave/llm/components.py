"""Buckets of candidates: stars to verify first, and what is still apart after that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components

__all__ = ["components", "open_members", "stars"]


def stars(members: DataFrame) -> DataFrame:
    """Pairs (a, center) of a node and the center of each of its buckets, the node of the
    greatest weight (then the greatest id). members: bucket, node, weight."""
    centers = members.groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(centers, "bucket").where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, label of the buckets whose nodes aren't all of one component yet."""
    tagged = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    split = tagged.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    return tagged.join(split, "bucket")
