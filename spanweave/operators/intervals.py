"""Intervals as DataFrames: merging, binning, depth, and joins by overlap or nearness.

Intervals are half-open. ``by`` names the columns that part the data (a chromosome, a strand, a
sample); start and end may be any numeric columns. Sweeps over positions (depth, maxima, repeats, merging, nearest
targets) run within tiles, which get what lies beyond them from a row for each tile, so that a long chromosome or a deep
sample spreads. Segments and cliques are ordered within ``by`` alone: theirs is a gene.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a stretch that one task sweeps.
TILE = 1 << 20


def merge_intervals(df: DataFrame, by: list[str], start: str = "start", end: str = "end", gap: int = 0, touching: bool = True) -> DataFrame:
    """Unite intervals that overlap, touch, or stand at most ``gap`` apart: by, start, end, n.

    Equal intervals are counted before the sort, and islands are first formed within tiles of
    the start so that a hot group is reduced in parallel; a second pass unites the islands of
    neighbouring tiles."""
    counted = df.where(F.col(start) < F.col(end)).groupBy(*by, start, end).agg(F.count(F.lit(1)).alias("n"))
    tile = F.floor(F.col(start) / F.lit(TILE))
    first = _islands(counted.withColumn("__tile", tile), [*by, "__tile"], start, end, gap, touching)
    return _islands(first.select(*by, start, end, "n"), by, start, end, gap, touching)


def _islands(df: DataFrame, by: list[str], start: str, end: str, gap: int, touching: bool) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)) + gap
    opens = before.isNull() | (F.col(start) > before if touching else F.col(start) >= before)
    island = F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__island", island).groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("__island")


def bin_counts(df: DataFrame, by: list[str], start: str, end: str, size: int, origin: int = 1) -> DataFrame:
    """How many intervals reach each bin of ``size`` from ``origin``: by, bin, n. A span counts in
    every bin it touches, gaps inside it included. Counted by first and last bin before the
    explode, so that equal spans cost one row."""
    spans = df.select(*by, F.floor((F.col(start) - origin) / size).alias("lo"), F.floor((F.col(end) - 1 - origin) / size).alias("hi")).groupBy(*by, "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return spans.select(*by, F.explode(F.sequence("lo", "hi")).alias("bin"), "n").groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def drop_repeats(df: DataFrame, by: list[str], order: list[str], same: list[str], tile: int = TILE) -> DataFrame:
    """Drop a row whose ``same`` columns equal those of the row before it, in ``order``. Where the order begins with these
    columns equal rows follow each other, so that a group keeps its first row: repeats are gone before the shuffle. Otherwise
    tiles of the first order column get the last row of the tile before them as a row of their own."""
    if set(order[: len(same)]) == set(same):
        rest = [c for c in df.columns if c not in (*by, *same)]
        later = [F.col(c) for c in order[len(same) :]] or [F.lit(0)]
        first = F.min_by(F.struct(*(rest or [F.lit(0).alias("__none")])), F.struct(*later)).alias("__first")
        return df.groupBy(*by, *(c for c in same if c not in by)).agg(first).select(*(F.col(f"__first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns))
    tiled = df.withColumn("__tile", F.floor(F.col(order[0]) / tile)).withColumn("__key", F.struct(*same))
    lasts = tiled.groupBy(*by, "__tile").agg(F.max_by("__key", F.struct(*order)).alias("__last"))
    before = lasts.select(*by, "__tile", F.lag("__last").over(Window.partitionBy(*by).orderBy("__tile")).alias("__key")).where("__key is not null")
    both = tiled.withColumn("__own", F.lit(1)).unionByName(before.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    last = F.lag("__key").over(Window.partitionBy(*by, "__tile").orderBy("__own", *order))
    return both.withColumn("__repeat", last.isNotNull() & F.col("__key").eqNullSafe(last)).where("__own = 1 and not __repeat").select(*df.columns)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left with right's other columns, equal nulls of the key columns meeting each other."""
    named = right.select(*(F.col(c).alias(f"__r_{c}") for c in on), *(c for c in right.columns if c not in on))
    condition = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on))
    return left.join(named, condition).drop(*(f"__r_{c}" for c in on))


def depth_runs(df: DataFrame, by: list[str], start: str = "start", end: str = "end", tile: int = TILE) -> DataFrame:
    """Depth as runs: by, start, end, depth (above 0), from a sweep over starts and ends. Each tile of positions is
    swept by itself, from the depth that the tiles before it leave and up to where the next one begins."""
    steps = df.select(*by, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("step")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("step")))).alias("e"))
    steps = steps.withColumn("__tile", F.floor(F.col("e.pos") / tile)).groupBy(*by, "__tile", "e.pos").agg(F.sum("e.step").alias("step")).where("step <> 0")
    sums = steps.groupBy(*by, "__tile").agg(F.sum("step").alias("__net"), F.min("pos").alias("__first"))
    over = Window.partitionBy(*by).orderBy("__tile")
    carried = F.coalesce(F.sum("__net").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # what a tile has to know is one more row of it, its first
    edges = sums.select(*by, "__tile", carried.alias("step"), F.lead("__first").over(over).alias("__next"), F.lit(0).alias("__own"))
    both = steps.withColumn("__own", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    w = Window.partitionBy(*by, "__tile").orderBy("__own", "pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    end = F.coalesce(F.lead("pos").over(w), F.first("__next").over(upto))
    runs = both.select(*by, F.col("pos").alias("start"), end.alias("end"), F.sum("step").over(upto).alias("depth"), "__own")
    return runs.where("__own = 1 and depth > 0").drop("__own")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], size: int, left_cols=("start", "end"), right_cols=("r_start", "r_end")) -> DataFrame:
    """Pairs that share a base. Both sides go to the bins they touch; a pair is kept in the first
    bin that both touch, so it is found once. The right side's columns must have other names."""
    ls, le, rs, re = (F.col(c) for c in (*left_cols, *right_cols))
    to_bins = lambda df, s, e: df.withColumn("__bin", F.explode(F.sequence(F.floor(s / size), F.floor((e - 1) / size))))
    joined = to_bins(left, ls, le).join(to_bins(right, rs, re), [*by, "__bin"])
    first = F.greatest(F.floor(ls / size), F.floor(rs / size))
    return joined.where((ls < re) & (rs < le) & (F.col("__bin") == first)).drop("__bin")


def shared_bases(left: tuple[str, str], right: tuple[str, str]) -> Column:
    return F.greatest(F.least(F.col(left[1]), F.col(right[1])) - F.greatest(F.col(left[0]), F.col(right[0])), F.lit(0))


def nearest_after(sites: DataFrame, targets: DataFrame, by: list[str], low: int, high: int, pos: str = "pos", tile: int = 1 << 16) -> DataFrame:
    """For each site (repeats kept) the nearest target at a distance of low to high: target or
    null. No range join: targets are moved back by low, and a running last value over falling
    positions is the next one at or after a site. A target lies in its own tile of positions and
    in the one before it, which is as far as a site may look, so a long chromosome spreads."""
    size = max(tile, high - low + 1, 1)
    home = F.floor(F.col("at") / size)
    both = sites.select(*by, F.col(pos).alias("at"), F.lit(None).cast("long").alias("target"), F.lit(0).alias("kind")).withColumn("__tile", home)
    ends = targets.select(*by, (F.col(pos) - low).alias("at"), F.col(pos).cast("long").alias("target"), F.lit(1).alias("kind")).distinct()
    both = both.unionByName(ends.withColumn("__tile", F.explode(F.array(home, home - 1))))
    w = Window.partitionBy(*by, "__tile").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("target", F.last("target", ignorenulls=True).over(w)).where("kind = 0")
    return found.select(*by, F.col("at").alias(pos), F.when(F.col("target") - F.col("at") <= high, F.col("target")).alias("target"))


def nearest_before(sites: DataFrame, targets: DataFrame, by: list[str], low: int, high: int, pos: str = "pos") -> DataFrame:
    """The mirror image of nearest_after."""
    flip = lambda df: df.withColumn(pos, -F.col(pos))
    found = nearest_after(flip(sites), flip(targets), by, low, high, pos)
    return found.select(*by, (-F.col(pos)).alias(pos), (-F.col("target")).alias("target"))


def lone(sites: DataFrame, targets: DataFrame, by: list[str], reach: int, pos: str = "pos", tile: int = 1 << 16) -> DataFrame:
    """Distinct sites without a target at a distance of up to reach, on either side: by, pos. A stretch of a few positions
    is one row: its sites as bits, its first and last target. In a stretch no wider than reach any target is near its
    sites; beyond it the last target before and the first one after it count. Tiles of positions also get the
    targets within reach of them. A null meets nothing."""
    size = min(reach + 1, 62)
    wide = max(tile // size, reach // size + 2)  # stretches of a tile
    p, start = F.col(pos), F.col("__bin") * size
    none = F.lit(None).cast("long")
    at = F.floor(p / size).alias("__bin")
    bit = F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), (p - F.floor(p / size) * size).cast("int")), F.lit(1).cast("long"))
    known = targets.dropna(subset=[*by, pos])
    both = sites.select(*by, at, bit.alias("__sites"), none.alias("__low"), none.alias("__high"))
    both = both.unionByName(known.select(*by, at, F.lit(0).cast("long").alias("__sites"), p.cast("long").alias("__low"), p.cast("long").alias("__high")))
    bins = both.groupBy(*by, "__bin").agg(F.bit_or("__sites").alias("__sites"), F.min("__low").alias("__low"), F.max("__high").alias("__high"))
    home = F.floor(F.col("__bin") / wide)
    tile_at = lambda x: F.floor(F.floor(x / size) / wide)
    seen = F.when(F.col("__low").isNull(), F.array(home)).otherwise(F.array_distinct(F.array(home, tile_at(F.col("__low") - reach), tile_at(F.col("__high") + reach))))
    w = Window.partitionBy(*by, "__tile")
    before = F.max("__high").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("__low").over(w.orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1))
    tiled = bins.withColumn("__tile", F.explode(seen)).withColumn("__before", before).withColumn("__after", after)
    held = tiled.where(F.col("__tile").eqNullSafe(home) & (F.col("__sites") != 0) & F.col("__low").isNull())
    offsets = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.call_function("shiftright", F.col("__sites"), i).bitwiseAND(F.lit(1)) == 1)
    held = held.select(*by, "__before", "__after", "__bin", F.explode(offsets).alias("__offset"))
    found = held.select(*by, "__before", "__after", (start + F.col("__offset")).alias(pos))
    found = found.where((F.col("__before").isNull() | (p - F.col("__before") > reach)) & (F.col("__after").isNull() | (F.col("__after") - p > reach)))
    return found.select(*by, p.cast(sites.schema[pos].dataType).alias(pos))


def local_maxima(df: DataFrame, by: list[str], pos: str, value: str, reach: int, tile: int = TILE) -> DataFrame:
    """Rows whose value is the greatest within reach on both sides, the leftmost of equals. A tile sees the rows within
    reach of it too."""
    size = max(tile, reach, 1)
    home = F.floor(F.col(pos) / size)
    halo = df.withColumn("__home", home).withColumn("__tile", F.explode(F.array_distinct(F.array(home, F.floor((F.col(pos) - reach) / size), F.floor((F.col(pos) + reach) / size)))))
    w = Window.partitionBy(*by, "__tile").orderBy(pos)
    top = F.max(value).over(w.rangeBetween(-reach, reach))
    earlier = F.max(value).over(w.rangeBetween(-reach, -1))
    found = halo.withColumn("__top", top).withColumn("__earlier", earlier).where("__home = __tile")
    return found.where((F.col(value) == F.col("__top")) & (F.col("__earlier").isNull() | (F.col("__earlier") < F.col(value)))).drop("__top", "__earlier", "__home", "__tile")


def segments(bounds: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Atomic segments between consecutive distinct bounds: by, seg_idx, start, end."""
    w = Window.partitionBy(*by).orderBy(pos)
    cut = bounds.select(*by, pos).distinct()
    found = cut.select(*by, (F.row_number().over(w) - 1).alias("seg_idx"), F.col(pos).alias("start"), F.lead(pos).over(w).alias("end"))
    return found.where("end is not null")


def segment_index(elements: DataFrame, segs: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The first and last segment of each element, by equal bounds."""
    first = segs.select(*by, F.col("start").alias(start), F.col("seg_idx").alias("first_seg"))
    last = segs.select(*by, F.col("end").alias(end), F.col("seg_idx").alias("last_seg"))
    return elements.join(first, [*by, start]).join(last, [*by, end])


def runs(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Runs of consecutive integers: by, first, last. Only neighbours are looked at, so that one sort is all a task holds."""
    w = Window.partitionBy(*by).orderBy(index)
    opens = F.coalesce(F.lag(index).over(w) != F.col(index) - 1, F.lit(True))
    closes = F.coalesce(F.lead(index).over(w) != F.col(index) + 1, F.lit(True))
    ends = df.select(*by, index).distinct().withColumn("__opens", opens).withColumn("__closes", closes).where("__opens or __closes")
    # a run's closing row follows its opening one, if it isn't the same
    last = F.when(F.col("__closes"), F.col(index)).otherwise(F.lead(index).over(w))
    return ends.withColumn("__last", last).where("__opens").select(*by, F.col(index).alias("first"), F.col("__last").alias("last"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _turns(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """by, pos, starts, done (cliques that are complete there or before), complete, since (the position before), open: the
    borders of spans in order. A clique is complete where spans end after others began."""
    borders = spans.where(F.col(start) < F.col(end)).select(*by, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("starts"), F.lit(0).alias("ends")), F.struct(F.col(end).alias("pos"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))).alias("b"))
    counted = borders.groupBy(*by, "b.pos").agg(F.sum("b.starts").alias("starts"), F.sum("b.ends").alias("ends"))
    order = Window.partitionBy(*by).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    complete = (F.col("ends") > 0) & (F.lag("starts").over(order) > 0)
    rows = counted.withColumn("complete", complete).withColumn("since", F.lag("pos").over(order)).withColumn("open", F.sum(F.col("starts") - F.col("ends")).over(upto))
    return rows.withColumn("done", F.sum(F.col("complete").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def cliques(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """by, clique (from 0), start, end, size: the stretch that all spans of a maximal clique of overlap share."""
    return _turns(spans, by, start, end).where("complete").select(*by, (F.col("done") - 1).alias("clique"), F.col("since").alias("start"), F.col("pos").alias("end"), F.col("open").alias("size"))


def clique_runs(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """spans with first_clique and last_clique. The cliques of a span follow each other, so that spans of equal first and
    last ones are in the same cliques."""
    turns = _turns(spans, by, start, end)
    first = turns.where("starts > 0").select(*by, F.col("pos").alias(start), F.col("done").alias("first_clique"))
    last = turns.where("ends > 0").select(*by, F.col("pos").alias(end), (F.col("done") - 1).alias("last_clique"))
    return spans.join(first, [*by, start]).join(last, [*by, end])
