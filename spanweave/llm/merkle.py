"""Merkle trees over rows: one tree for each group, one over the groups' roots, a proof for each row.

Rows are ranked within their group by a range shuffle. Trees are then climbed a block of
``arity ** depth`` slots at a time: within a block the nodes of level l stand on the rows whose slot
divides by arity ** l, so that lag and lead columns of fixed offsets, masked by slot and run length,
supply the siblings, and the first child's row hashes the parent. All levels of a block share one
sort. The blocks' tops are the rows of the next round. Proofs come down the same way, by lags.

A hash is lower-case hex sha256; parents hash their children's hex texts joined; a run that is short
(even one node) is hashed as it is; a single node of a tree is its root and isn't hashed again.

Nulls: a null field is hashed as ``-``, a null group is a group of its own and the first, null order
values come first. Ties and repeated rows follow each other by their hash, equal ones in any order.
An empty table gives no rows. Other columns, whatever their names, are left aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ARITY = 2
#: Levels in a block: 64 rows of a tree of two children a node.
DEPTH = 6


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(col: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*cols: Column) -> Column:
    return digest(*map(field, cols))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, s: digest(s["left"], node, s["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df (tree, node, ...) with slot, its place in its tree by order from 0, and size, the tree's rows."""
    rows = df.withColumn("seq", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "node", "seq")]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("seq").withColumn("at", F.monotonically_increasing_id()), "merkle-ranked").withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return placed.join(offsets, ["tree", "part"]).withColumn("slot", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _level(step: int) -> Column:
    """Whether a tree still has several nodes of which each covers step leaves."""
    return F.col("size") > step


def _climbed(nodes: DataFrame, arity: int, depth: int) -> tuple[DataFrame, Window]:
    """nodes with block, n0 to n<depth> (the node of each level on its first row) and s0 to s<depth-1> (its siblings)."""
    window = Window.partitionBy("tree", "block").orderBy("slot")
    slot, size = F.col("slot"), F.col("size")
    df = nodes.withColumn("block", F.floor(slot / arity**depth)).withColumnRenamed("node", "n0")
    for level in range(depth):
        step, node = arity**level, f"n{level}"
        digit = F.floor(slot / step) % arity
        left = F.concat_ws("", *(F.when(digit >= j, F.lag(node, j * step).over(window)) for j in range(arity - 1, 0, -1)))
        right = F.concat_ws("", *(F.when((digit + j < arity) & (slot + j * step < size), F.lead(node, j * step).over(window)) for j in range(1, arity)))
        df = df.withColumn(f"s{level}", F.when((slot % step == 0) & _level(step), F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(_level(step), digest(F.col(node), F.col(f"s{level}.right"))).otherwise(F.col(node))
        df = df.withColumn(f"n{level + 1}", F.when(slot % (step * arity) == 0, parent))
    return df, window


def _tops(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    found, _ = _climbed(nodes, arity, depth)
    top = found.where(F.col("slot") % arity**depth == 0)
    return cut(top.select("tree", F.col("block").alias("slot"), F.ceil(F.col("size") / arity**depth).alias("size"), F.col(f"n{depth}").alias("node")), "merkle-tops")


def _with_paths(nodes: DataFrame, upper: DataFrame, arity: int, depth: int) -> DataFrame:
    """nodes with the siblings up to their block's top and, from there, those of upper (tree, block, path, ...)."""
    df, window = _climbed(nodes, arity, depth)
    none = F.array().cast("array<struct<left:string,right:string>>")
    df = df.withColumn("path", none)
    for level in reversed(range(depth)):
        step, own = arity**level, F.col(f"s{level}")
        digit = F.floor(F.col("slot") / step) % arity
        above = F.col("path")
        for j in range(1, arity):
            above = F.when(digit == j, F.lag("path", j * step).over(window)).otherwise(above)
        df = df.withColumn("path", F.when(F.col("slot") % step == 0, F.concat(F.when(own.isNotNull(), F.array(own)).otherwise(none), above)))
    inner = df.drop(*(f"s{i}" for i in range(depth)), *(f"n{i}" for i in range(1, depth + 1))).withColumnRenamed("n0", "node")
    met = inner.join(upper.withColumnRenamed("path", "upper"), ["tree", "block"])
    return met.withColumn("path", F.concat("path", "upper")).drop("upper", "block")


def _rounds(nodes: DataFrame, arity: int, depth: int) -> list[DataFrame]:
    """The nodes of each round; those of the last one are the trees' roots."""
    found, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while len(found) == 1 or most > 1:
        found.append(_tops(found[-1], arity, depth))
        most = -(-most // arity**depth)
    return found


def _proved(nodes: DataFrame, over_roots, arity: int, depth: int) -> DataFrame:
    """nodes (tree, slot, size, node, ...) with path and whatever over_roots gives for (tree, node) of the roots."""
    rounds = _rounds(nodes, arity, depth)
    upper = over_roots(rounds[-1].select("tree", "node")).withColumn("block", F.lit(0).cast("long"))
    for number in range(len(rounds) - 2, 0, -1):
        found = _with_paths(rounds[number], upper, arity, depth)
        upper = found.drop("size", "node").withColumnRenamed("slot", "block")
    return _with_paths(rounds[0], upper, arity, depth)


def manifest(rows: DataFrame, hashed: list[str], group: str, order: str, arity: int = ARITY, depth: int = DEPTH, **keep: Column) -> DataFrame:
    """For each row: the columns of keep, leaf (the hash of the hashed columns), subroot (of its group's tree),
    root (of the tree over the groups, in the order of their UTF-8 bytes, null first) and path, the siblings from
    the leaf to the root as an array of left and right (each the joined hashes on that side).

    keep gives names and values to carry along; they must not be named as the columns added here.
    Memory: a block of arity ** depth rows. The text of a row goes no further than its own hash."""
    taken = {"tree", "node", "seq", "at", "part", "size", "slot", "block", "path", "upper", "subroot", "root", "order"} & set(keep)
    if taken or arity < 2 or depth < 1:
        raise ValueError(f"names in use: {', '.join(sorted(taken))}" if taken else "a tree needs two children a node and a level a block")
    name = F.col(group).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), name), F.lit(""))  # null before the empty text
    leaves = cut(rows.select(tree.alias("tree"), F.col(order).alias("order"), leaf(*map(F.col, hashed)).alias("node"), *(c.alias(n) for n, c in keep.items())), "merkle-leaves")

    def over_groups(roots: DataFrame) -> DataFrame:
        one = _ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node"), ["group"])
        single = lambda top: top.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("node").alias("root"))
        return cut(_proved(one, single, arity, depth).select(F.col("group").alias("tree"), "path", F.col("node").alias("subroot"), "root"), "merkle-roots")

    found = _proved(_ranked(leaves, ["order"]), over_groups, arity, depth)
    return found.select(*keep, F.col("node").alias("leaf"), "subroot", "root", "path")
