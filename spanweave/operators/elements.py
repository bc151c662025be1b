"""Gene elements: terminal exons, inner exons between splice sites, sites of reads, thin stretches.

``by`` parts the data (chromosome, strand, gene). Strand ``-`` is handled by mirroring positions,
so that every rule is written once, in the direction of the transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from . import intervals as iv


def along(pos: Column, strand: str = "strand") -> Column:
    """Positions that grow in the direction of the strand; applied twice it gives back pos."""
    return F.when(F.col(strand) == "-", -pos).otherwise(pos)


def _mirrored(df: DataFrame, pos: str = "pos") -> DataFrame:
    return df.withColumn(pos, along(F.col(pos)))


def _exons(found: DataFrame, by: list[str]) -> DataFrame:
    pos, target = along(F.col("pos")), along(F.col("target"))
    return found.where("target is not null").select(*by, F.least(pos, target).alias("start"), F.greatest(pos, target).alias("end"))


def first_exons(starts: DataFrame, stops: DataFrame, introns: DataFrame, by: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """Each start site (repeats kept) with the nearest stop site or intron begin, as seen along the
    strand, at a distance an exon may have: by, start, end. by must hold ``strand``."""
    bounds = iv.union_all([stops.select(*by, "pos"), introns.select(*by, F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")).alias("pos"))])
    return _exons(iv.nearest_after(_mirrored(starts.select(*by, "pos")), _mirrored(bounds), by, settings.min_exon, settings.max_exon), by)


def last_exons(starts: DataFrame, stops: DataFrame, introns: DataFrame, by: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """Each stop site (repeats kept) with the nearest start site or intron end before it."""
    bounds = iv.union_all([starts.select(*by, "pos"), introns.select(*by, F.when(F.col("strand") == "-", F.col("start")).otherwise(F.col("end")).alias("pos"))])
    return _exons(iv.nearest_before(_mirrored(stops.select(*by, "pos")), _mirrored(bounds), by, settings.min_exon, settings.max_exon), by)


def inner_exons(introns: DataFrame, by: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """Pairs of an intron's end and another's start, an exon's size apart, with no border of a
    spliced intron strictly between: by, start, end. introns: by, start, end, spliced (boolean).

    The borders of spliced introns cut a gene into windows, ends included, and both sides meet
    within a window only."""
    borders = introns.where("spliced").select(*by, F.explode(F.array("start", "end")).alias("p")).groupBy(*by).agg(F.sort_array(F.collect_set("p")).alias("borders"))

    def placed(pos: str) -> DataFrame:
        rows = introns.select(*by, F.col(pos).alias(f"at_{pos}")).distinct().join(borders, by, "left")
        upto = F.size(F.filter(F.coalesce("borders", F.array().cast("array<bigint>")), lambda b: b <= F.col(f"at_{pos}")))
        on = F.coalesce(F.array_contains("borders", F.col(f"at_{pos}")), F.lit(False))
        return rows.select(*by, f"at_{pos}", F.explode(F.when(on, F.array(upto - 1, upto)).otherwise(F.array(upto))).alias("window"))

    met = placed("end").join(placed("start"), [*by, "window"])
    return met.where(F.col("at_start") - F.col("at_end").cast("long") >= settings.min_exon).where(F.col("at_start") - F.col("at_end") <= settings.max_exon).select(*by, F.col("at_end").alias("start"), F.col("at_start").alias("end")).distinct()


def unused_borders(introns: DataFrame, exons: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Intron starts that end no exon, and intron ends that begin none."""
    starts = introns.select(*by, F.col("start").alias("pos")).distinct().join(exons.select(*by, F.col("end").alias("pos")), [*by, "pos"], "left_anti")
    ends = introns.select(*by, F.col("end").alias("pos")).distinct().join(exons.select(*by, F.col("start").alias("pos")), [*by, "pos"], "left_anti")
    return starts, ends


def without_gaps(exons: DataFrame, depth: DataFrame, by: list[str], samples: DataFrame, cutoff: int, settings: Settings = DEFAULT) -> DataFrame:
    """Exons whose best sample has at most ``max_gap_bases`` bases under the cutoff.

    depth: runs (by, sample, start, end, depth); samples: the sample column, a row for each. A sample
    without any run there is all gap, so it never is the best unless all are."""
    deep = depth.where(F.col("depth") >= cutoff).select(*by, "sample", F.col("start").alias("d_start"), F.col("end").alias("d_end"))
    met = iv.overlap_join(exons.select(*by, "start", "end").distinct(), deep, by, 1000, ("start", "end"), ("d_start", "d_end"))
    best = met.groupBy(*by, "start", "end", "sample").agg(F.sum(iv.shared_bases(("start", "end"), ("d_start", "d_end"))).alias("deep")).groupBy(*by, "start", "end").agg(F.max("deep").alias("deep"))
    found = exons.join(best, [*by, "start", "end"], "left")
    return found.where(F.col("end") - F.col("start") - F.coalesce("deep", F.lit(0)) <= settings.max_gap_bases).drop("deep")


def site_votes(reads: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Ends of reads with their evidence: kind ``start`` or ``stop``, along the strand. reads: by, rs, re, fl."""
    left = (F.col("strand") == "-") if kind == "stop" else (F.col("strand") != "-")
    return reads.groupBy(*by, F.when(left, F.col("rs")).otherwise(F.col("re")).alias("pos")).agg(F.sum("fl").alias("votes"))


def gene_sites(known: DataFrame, annotated: DataFrame, reads: DataFrame, by: list[str], kind: str, settings: Settings = DEFAULT) -> DataFrame:
    """The sites of each gene: the known ones, else annotated ones; and the outermost end of its
    reads where there is no site or it lies ``site_distance`` or more outside of all."""
    outer = 1 if kind == "stop" else -1
    ends = _mirrored(site_votes(reads, by, kind)).groupBy(*by).agg((F.max(F.col("pos") * outer) * outer).alias("far"))
    spare = annotated.select(*by, "pos").distinct().join(known.select(*by), by, "left_anti")
    sites = known.select(*by, "pos").unionByName(spare)
    edge = _mirrored(sites).groupBy(*by).agg((F.max(F.col("pos") * outer) * outer).alias("edge"))
    more = ends.join(edge, by, "left").where(F.col("edge").isNull() | ((F.col("far") - F.col("edge")) * outer >= settings.site_distance))
    return sites.unionByName(more.select(*by, along(F.col("far")).alias("pos")))


def away_from(sites: DataFrame, others: DataFrame, by: list[str], distance: int) -> DataFrame:
    """Sites without another one at less than distance, on either side."""
    lone = iv.lone(sites.select(*by, "pos"), others.select(*by, "pos"), by, distance - 1)
    return sites.join(lone, [*by, "pos"], "left_semi")


def moved_introns(blocks: Column, start: Column, end: Column) -> Column:
    """Blocks whose edges move to a given intron where it lies between their neighbours' edges."""
    n = F.size(blocks)

    def step(b: Column, i: Column) -> Column:
        right = F.when(i == n - 1, b["end"]).otherwise(F.get(blocks, i + 1)["start"])
        left = F.when(i == 0, b["start"]).otherwise(F.get(blocks, i - 1)["end"])
        stop = F.when((b["start"] < start) & (start < right), start).otherwise(b["end"])
        begin = F.when((left < end) & (end < stop), end).otherwise(b["start"])
        return F.struct(begin.alias("start"), stop.alias("end"))

    return F.transform(blocks, step)


def query_offset(cigar: Column, start: Column, pos: Column) -> Column:
    """The place in a read of a reference position: bases of the read before it, gaps not counted."""
    zero = F.struct(start.cast("long").alias("ref"), F.lit(0).cast("long").alias("query"), F.lit(None).cast("long").alias("found"))

    def step(acc: Column, c: Column) -> Column:
        on_ref, on_query = c["op"].isin(0, 2, 3, 6), c["op"].isin(0, 1, 4, 5)
        inside = acc["found"].isNull() & on_ref & (pos < acc["ref"] + c["len"]) & (pos >= acc["ref"])
        here = acc["query"] + F.when(on_query, pos - acc["ref"]).otherwise(0)
        return F.struct((acc["ref"] + F.when(on_ref, c["len"]).otherwise(0)).alias("ref"), (acc["query"] + F.when(on_query, c["len"]).otherwise(0)).alias("query"), F.when(inside, here).otherwise(acc["found"]).alias("found"))

    return F.aggregate(cigar, zero, step)["found"]


def read_bases(seq: Column, cigar: Column, read_start: Column, start: Column, end: Column) -> Column:
    """The read's bases over a reference range; null where an end of the range is not on the read."""
    first, last = query_offset(cigar, read_start, start), query_offset(cigar, read_start, end - 1)
    return F.substring(seq, (first + 1).cast("int"), (last - first + 1).cast("int"))


def splice_pairs(introns: DataFrame, genome: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """introns (id, chrom, start, end, strand) with first and last, the two letters at both ends of
    the intron as read along the strand. genome: chunks of sequences."""
    from ..sources.formats import subsequences
    from .reads import reverse_complement

    at = introns.select("id", "chrom", F.col("start").alias("s"), F.col("end").alias("e"))
    ends = at.select(F.concat_ws(":", "id", F.lit("l")).alias("id"), "chrom", F.col("s").alias("start"), (F.col("s") + 2).alias("end")).unionByName(at.select(F.concat_ws(":", "id", F.lit("r")).alias("id"), "chrom", (F.col("e") - 2).alias("start"), F.col("e").alias("end")))
    pairs = subsequences(ends, genome, chunk).select(F.substring_index("id", ":", 1).alias("k"), F.substring_index("id", ":", -1).alias("side"), F.upper("seq").alias("seq"))
    both = pairs.groupBy("k").agg(F.max(F.when(F.col("side") == "l", F.col("seq"))).alias("left"), F.max(F.when(F.col("side") == "r", F.col("seq"))).alias("right"))
    met = introns.join(both, F.col("id").cast("string") == F.col("k"))
    minus = F.col("strand") == "-"
    return met.select(*introns.columns, F.when(minus, reverse_complement(F.col("right"))).otherwise(F.col("left")).alias("first"), F.when(minus, reverse_complement(F.col("left"))).otherwise(F.col("right")).alias("last"))
