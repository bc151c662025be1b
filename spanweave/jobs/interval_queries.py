"""Queries on merging, binning, depth and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import poisson_quantile
from ..operators import intervals as iv
from .tables import ALN, aln, table

SITE = ["chrom", "strand"]


def _islands_sql(source: str, by: str, start: str, end: str, opens: str) -> str:
    """Islands of distinct intervals (repeats would tie in the windows), with their counts."""
    order = f"PARTITION BY {by} ORDER BY {start}, {end}"
    return f"""SELECT {by}, min({start}) AS {start}, max({end}) AS {end}, CAST(sum(c) AS BIGINT) AS n FROM (
 SELECT *, sum(CASE WHEN m IS NULL OR {opens} THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, max({end}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (
 SELECT {by}, {start}, {end}, count(*) AS c FROM {source} GROUP BY {by}, {start}, {end}))) GROUP BY {by}, g"""


def q_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge_intervals(aln(spark, sf_dir), SITE, "rs", "re")


Q_INTERVAL_MERGE = f"WITH {ALN} " + _islands_sql("aln", "chrom, strand", "rs", "re", "rs > m")


def q_interval_merge_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after the gap, where only a shared base unites."""
    return iv.merge_intervals(aln(spark, sf_dir), SITE, "acceptor", "re", touching=False)


Q_INTERVAL_MERGE_TOUCHING = f"WITH {ALN} " + _islands_sql("aln", "chrom, strand", "acceptor", "re", "acceptor >= m")


def q_linkage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of two sources, united."""
    reads = aln(spark, sf_dir)
    left, right = (reads.select("chrom", s, e).toDF("chrom", "start", "end") for s, e in (("rs", "donor"), ("acceptor", "re")))
    merged = [iv.merge_intervals(x, ["chrom"]).select("chrom", "start", "end") for x in (left, right)]
    return iv.merge_intervals(iv.union_all(merged), ["chrom"]).select("chrom", "start", "end")


Q_LINKAGE_UNION = f"WITH {ALN}, both_ AS (SELECT chrom, rs AS start, donor AS stop FROM aln UNION ALL SELECT chrom, acceptor, re FROM aln) SELECT chrom, start, stop AS \"end\" FROM ({_islands_sql('both_', 'chrom', 'start', 'stop', 'start > m')})"


def q_bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.bin_counts(aln(spark, sf_dir), ["chrom"], "rs", "re", 100)


_BINS = "SELECT chrom, unnest(generate_series((rs - 1) // 100, (re - 2) // 100)) AS bin"
Q_BIN_COUNTS = f"WITH {ALN} SELECT chrom, bin, count(*) AS n FROM ({_BINS} FROM aln) GROUP BY chrom, bin"
_SAME = ["rs", "re", "strand"]


def q_bin_counts_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of one sample's reads, without those that repeat the read before."""
    kept = iv.drop_repeats(aln(spark, sf_dir), ["chrom", "sample"], ["rs", "re", "strand", "fl", "name"], _SAME)
    return iv.bin_counts(kept, ["chrom"], "rs", "re", 100)


Q_BIN_COUNTS_DEDUP = f"""WITH {ALN}, k AS (SELECT *, lag(rs) OVER w = rs AND lag(re) OVER w = re AND lag(strand) OVER w = strand AS again FROM aln WINDOW w AS (PARTITION BY chrom, sample ORDER BY rs, re, strand, fl, name))
SELECT chrom, bin, count(*) AS n FROM ({_BINS} FROM k WHERE again IS NULL OR NOT again) GROUP BY chrom, bin"""


def _cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: reads a bin at the mean rate would pass with probability alpha."""
    totals = aln(spark, sf_dir).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.max("re").alias("size"))
    one = totals.agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    return one.select(poisson_quantile(F.col("n") * 100 / F.col("size")).alias("cutoff"))


def q_poisson_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cutoff(spark, sf_dir)


_QUANTILE = """(WITH RECURSIVE lam AS (SELECT sum(n) * 100.0 / sum(size) AS l FROM (SELECT count(*) AS n, max(re) AS size FROM aln GROUP BY chrom)),
 p(k, term, total) AS (SELECT 0, exp(-l), exp(-l) FROM lam UNION ALL SELECT k + 1, term * l / (k + 1), total + term * l / (k + 1) FROM p, lam WHERE total < 0.99)
 SELECT CAST(max(k) AS BIGINT) AS cutoff FROM p)"""
Q_POISSON_CUTOFF = f"WITH {ALN} SELECT cutoff FROM {_QUANTILE}"


def q_linkage_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of bins that hold more reads than the cutoff."""
    bins = q_bin_counts(spark, sf_dir).crossJoin(F.broadcast(_cutoff(spark, sf_dir))).where("n > cutoff")  # one row
    spans = bins.select("chrom", (F.col("bin") * 100 + 1).alias("start"), (F.col("bin") * 100 + 101).alias("end"))
    return iv.merge_intervals(spans, ["chrom"]).select("chrom", "start", "end")


Q_LINKAGE_REGIONS = f"""WITH {ALN}, b AS (SELECT chrom, bin*100 + 1 AS start, bin*100 + 101 AS stop FROM (SELECT chrom, bin, count(*) AS n FROM ({_BINS} FROM aln) GROUP BY chrom, bin), {_QUANTILE} q WHERE n > cutoff)
SELECT chrom, start, stop AS "end" FROM ({_islands_sql("b", "chrom", "start", "stop", "start > m")})"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = aln(spark, sf_dir)
    pair = F.explode(F.array(F.struct(F.col("rs").alias("start"), F.col("donor").alias("end")), F.struct(F.col("acceptor").alias("start"), F.col("re").alias("end"))))
    return reads.select("chrom", "strand", "sample", pair.alias("b")).select("chrom", "strand", "sample", "b.*")


_BLOCKS = "blocks AS (SELECT chrom, strand, sample, rs AS start, donor AS stop FROM aln UNION ALL SELECT chrom, strand, sample, acceptor, re FROM aln)"
_DEPTH = "depth AS (SELECT * FROM (SELECT {by}, pos AS start, lead(pos) OVER (PARTITION BY {by} ORDER BY pos) AS stop, sum(s) OVER (PARTITION BY {by} ORDER BY pos) AS depth FROM (SELECT {by}, pos, sum(s) AS s FROM (SELECT {by}, start AS pos, 1 AS s FROM blocks UNION ALL SELECT {by}, stop, -1 FROM blocks) GROUP BY {by}, pos HAVING sum(s) <> 0)) WHERE depth > 0)"


def q_base_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.depth_runs(_blocks(spark, sf_dir), ["chrom"])


Q_BASE_DEPTH = f"WITH {ALN}, {_BLOCKS}, {_DEPTH.format(by='chrom')} SELECT chrom, start, stop AS \"end\", CAST(depth AS BIGINT) AS depth FROM depth"


def q_depth_mean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose mean depth over covered bases is over 1.2, by chromosome."""
    runs = iv.depth_runs(_blocks(spark, sf_dir), ["chrom", "sample"])
    size = F.col("end") - F.col("start")
    mean = runs.groupBy("chrom", "sample").agg(F.sum(size).alias("covered"), F.sum(size * F.col("depth")).alias("bases"))
    return mean.select("chrom", "sample", "covered", F.round(F.col("bases") / F.col("covered"), 6).alias("mean_depth")).where("mean_depth > 1.2")


Q_DEPTH_MEAN_FILTER = f"WITH {ALN}, {_BLOCKS}, {_DEPTH.format(by='chrom, sample')} SELECT * FROM (SELECT chrom, sample, CAST(sum(stop - start) AS BIGINT) AS covered, round(sum((stop - start)*depth) / sum(stop - start), 6) AS mean_depth FROM depth GROUP BY chrom, sample) WHERE mean_depth > 1.2"


def q_gap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that at most 50 bases of thin depth (under 3) interrupt."""
    regions = q_interval_merge(spark, sf_dir).select("chrom", F.col("strand").alias("g_strand"), F.col("rs").alias("g_start"), F.col("re").alias("g_end"))
    runs = iv.depth_runs(_blocks(spark, sf_dir), ["chrom"]).where("depth >= 3")
    good = iv.overlap_join(regions, runs, ["chrom"], 1000, ("g_start", "g_end"), ("start", "end"))
    good = good.groupBy("chrom", "g_strand", "g_start", "g_end").agg(F.sum(iv.shared_bases(("g_start", "g_end"), ("start", "end"))).alias("deep"))
    return good.where("g_end - g_start - deep <= 50").select("chrom", F.col("g_strand").alias("strand"), F.col("g_start").alias("start"), F.col("g_end").alias("end"), "deep")


Q_GAP_FILTER = f"""WITH {ALN}, {_BLOCKS}, {_DEPTH.format(by="chrom")}, g AS ({_islands_sql("aln", "chrom, strand", "rs", "re", "rs > m")})
SELECT * FROM (SELECT g.chrom, g.strand, g.rs AS start, g.re AS "end", CAST(sum(least(re, stop) - greatest(rs, start)) AS BIGINT) AS deep FROM g JOIN depth d ON g.chrom = d.chrom AND rs < stop AND start < re AND depth >= 3 GROUP BY 1, 2, 3, 4) WHERE "end" - start - deep <= 50"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each strand's blocks."""
    return iv.merge_intervals(_blocks(spark, sf_dir), SITE).select("chrom", "strand", "start", "end")


_REGIONS = f"regions AS (SELECT chrom, strand, start, stop FROM ({_islands_sql('blocks', 'chrom, strand', 'start', 'stop', 'start > m')}))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _regions(spark, sf_dir)
    right = regions.where("strand = '-'").select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return iv.overlap_join(regions.where("strand = '+'").select("chrom", "start", "end"), right, ["chrom"], 500)


def q_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of both strands that share bases, with the larger share of either."""
    shared = iv.shared_bases(("start", "end"), ("r_start", "r_end"))
    ratio = F.greatest(shared / (F.col("end") - F.col("start")), shared / (F.col("r_end") - F.col("r_start")))
    return _pairs(spark, sf_dir).select("chrom", "start", "end", "r_start", "r_end", F.round(ratio, 6).alias("ratio"))


_PAIRS = "pairs AS (SELECT a.chrom, a.start, a.stop, b.start AS r_start, b.stop AS r_stop, least(a.stop, b.stop) - greatest(a.start, b.start) AS shared FROM regions a JOIN regions b ON a.chrom = b.chrom AND a.strand = '+' AND b.strand = '-' AND a.start < b.stop AND b.start < a.stop)"
Q_OVERLAP_PAIRS = f"WITH {ALN}, {_BLOCKS}, {_REGIONS}, {_PAIRS} SELECT chrom, start, stop AS \"end\", r_start, r_stop AS r_end, round(greatest(shared / (stop - start), shared / (r_stop - r_start)), 6) AS ratio FROM pairs"


def q_overlap_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.sum(iv.shared_bases(("start", "end"), ("r_start", "r_end")))
    return _pairs(spark, sf_dir).groupBy("chrom", "start", "end").agg(shared.alias("bases"))


Q_OVERLAP_BASES = f"WITH {ALN}, {_BLOCKS}, {_REGIONS}, {_PAIRS} SELECT chrom, start, stop AS \"end\", CAST(sum(shared) AS BIGINT) AS bases FROM pairs GROUP BY 1, 2, 3"


def q_cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region of one strand with the region of the other that shares most; ties go to the first."""
    shared = iv.shared_bases(("start", "end"), ("r_start", "r_end"))
    best = F.max_by(F.struct("r_start", "r_end"), F.struct(shared, -F.col("r_start")))
    found = _pairs(spark, sf_dir).groupBy("chrom", "start", "end").agg(best.alias("b"))
    return found.select("chrom", "start", "end", F.col("b.r_start").alias("to_start"), F.col("b.r_end").alias("to_end"))


Q_CLUSTER_ASSIGN = f"WITH {ALN}, {_BLOCKS}, {_REGIONS}, {_PAIRS} SELECT chrom, start, stop AS \"end\", r_start AS to_start, r_stop AS to_end FROM (SELECT *, row_number() OVER (PARTITION BY chrom, start, stop ORDER BY shared DESC, r_start) AS k FROM pairs) WHERE k = 1"


def q_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of one strand that share under 200 bases with each of the other."""
    regions = _regions(spark, sf_dir).where("strand = '+'").select("chrom", "start", "end")
    return regions.join(_pairs(spark, sf_dir).where(iv.shared_bases(("start", "end"), ("r_start", "r_end")) >= 200).select("chrom", "start", "end").distinct(), ["chrom", "start", "end"], "left_anti")


Q_UNASSIGNED = f"WITH {ALN}, {_BLOCKS}, {_REGIONS}, {_PAIRS} SELECT chrom, start, stop AS \"end\" FROM regions WHERE strand = '+' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.chrom = regions.chrom AND p.start = regions.start AND p.shared >= 200)"


def q_session_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that follow within half an hour, as one region of time."""
    events = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), (F.unix_micros(F.col("ts").cast("timestamp")) + 1).alias("end"))
    found = iv.merge_intervals(events, ["user_id"], gap=30 * 60 * 1_000_000 - 1)
    return found.select("user_id", "start", (F.col("end") - 1).alias("last"), "n")


Q_SESSION_REGIONS = f"WITH e AS (SELECT user_id, epoch_us(ts) AS start, epoch_us(ts) + 1 AS stop FROM events) SELECT user_id, start, stop - 1 AS last, n FROM ({_islands_sql('e', 'user_id', 'start', 'stop', 'start > m + 1799999999')})"

QUERIES = [q_interval_merge, q_interval_merge_touching, q_linkage_union, q_bin_counts, q_bin_counts_dedup, q_poisson_cutoff, q_linkage_regions, q_base_depth, q_depth_mean_filter, q_gap_filter, q_overlap_pairs, q_overlap_bases, q_cluster_assign, q_unassigned, q_session_regions]
SQL = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
