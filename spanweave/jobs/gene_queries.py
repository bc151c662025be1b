"""Queries on genes, sources of sites and introns, coverage of segments, and groups of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators.components import components
from .interval_queries import _BLOCKS, _PAIRS, _REGIONS, _pairs
from .tables import ALN, aln

SITE = ["chrom", "strand"]


def q_modal_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent read length of each sample, the least of equals."""
    sizes = aln(spark, sf_dir).groupBy("sample", (F.col("re") - F.col("rs")).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("sample").agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("length"))


Q_MODAL_LENGTH = f"WITH {ALN} SELECT sample, length FROM (SELECT sample, re - rs AS length, row_number() OVER (PARTITION BY sample ORDER BY count(*) DESC, re - rs) AS k FROM aln GROUP BY sample, re - rs) WHERE k = 1"


def q_genome_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = aln(spark, sf_dir).groupBy("chrom").agg(F.max("re").alias("size"))
    return sizes.agg(F.sum("size").alias("genome_size"), F.count(F.lit(1)).alias("n_chroms"))


Q_GENOME_SIZE = f"WITH {ALN} SELECT CAST(sum(size) AS BIGINT) AS genome_size, count(*) AS n_chroms FROM (SELECT max(re) AS size FROM aln GROUP BY chrom)"


def q_gene_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene spans widened by twice the site distance, kept within the chromosome."""
    reads = aln(spark, sf_dir)
    sizes = reads.groupBy("chrom").agg(F.max("re").alias("size"))
    spans = reads.groupBy(*SITE, F.expr("donor div 1500").alias("gene")).agg(F.min("rs").alias("lo"), F.max("re").alias("hi"), F.count(F.lit(1)).alias("n"))
    return spans.join(sizes, "chrom").select(*SITE, "gene", F.greatest(F.col("lo") - 1000, F.lit(1)).alias("start"), F.least(F.col("hi") + 1000, F.col("size")).alias("end"), "n")


Q_GENE_SPANS = f"WITH {ALN}, s AS (SELECT chrom, max(re) AS size FROM aln GROUP BY chrom) SELECT chrom, strand, gene, greatest(lo - 1000, 1) AS start, least(hi + 1000, size) AS \"end\", n FROM (SELECT chrom, strand, donor // 1500 AS gene, min(rs) AS lo, max(re) AS hi, count(*) AS n FROM aln GROUP BY 1, 2, 3) JOIN s USING (chrom)"


def q_intron_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns of two sources by coordinates; what the first says of an intron wins."""
    reads = aln(spark, sf_dir)
    part = lambda cond, name: reads.where(cond).groupBy(*SITE, "donor", "acceptor").agg(F.count(F.lit(1)).alias(name))
    both = part("fl <= 3", "short").join(part("fl > 3", "long"), [*SITE, "donor", "acceptor"], "full_outer")
    return both.select(*SITE, "donor", "acceptor", F.coalesce("short", "long").alias("support"), F.when(F.col("short").isNull(), "long").otherwise("short").alias("source"))


Q_INTRON_UNION = f"""WITH {ALN}, a AS (SELECT chrom, strand, donor, acceptor, count(*) AS n FROM aln WHERE fl <= 3 GROUP BY 1, 2, 3, 4), b AS (SELECT chrom, strand, donor, acceptor, count(*) AS m FROM aln WHERE fl > 3 GROUP BY 1, 2, 3, 4)
SELECT chrom, strand, donor, acceptor, coalesce(n, m) AS support, CASE WHEN n IS NULL THEN 'long' ELSE 'short' END AS source FROM a FULL OUTER JOIN b USING (chrom, strand, donor, acceptor)"""


def q_lone_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read ends without an acceptor within 30 bases on either side."""
    reads = aln(spark, sf_dir)
    return iv.lone(reads.select(*SITE, F.col("re").alias("pos")), reads.select(*SITE, F.col("acceptor").alias("pos")), SITE, 29)


Q_LONE_SITES = f"WITH {ALN}, s AS (SELECT DISTINCT chrom, strand, re AS pos FROM aln), t AS (SELECT DISTINCT chrom, strand, acceptor FROM aln) SELECT chrom, strand, pos FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.chrom = s.chrom AND t.strand = s.strand AND abs(acceptor - pos) < 30)"


def q_extreme_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known starts of a gene (those with an evidence of 30 or more), and its first read start where that
    stands 20 bases or more before them, or where none is known."""
    starts = aln(spark, sf_dir).groupBy(*SITE, F.expr("donor div 1500").alias("gene"), F.col("rs").alias("pos")).agg(F.sum("fl").alias("fl"))
    known = starts.where("fl >= 30").select(*SITE, "gene", "pos")
    ends = starts.groupBy(*SITE, "gene").agg(F.min("pos").alias("first"), F.min(F.when(F.col("fl") >= 30, F.col("pos"))).alias("known"))
    more = ends.where("known is null or first <= known - 20").select(*SITE, "gene", F.col("first").alias("pos"))
    return known.unionByName(more)


Q_EXTREME_SITES = f"""WITH {ALN}, s AS (SELECT chrom, strand, donor // 1500 AS gene, rs AS pos, sum(fl) AS fl FROM aln GROUP BY 1, 2, 3, 4)
SELECT chrom, strand, gene, pos FROM s WHERE fl >= 30 UNION ALL SELECT chrom, strand, gene, pos FROM (SELECT chrom, strand, gene, min(pos) AS pos, min(CASE WHEN fl >= 30 THEN pos END) AS known FROM s GROUP BY 1, 2, 3) WHERE known IS NULL OR pos <= known - 20"""


def q_segment_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each gene that cover at least half of each of its segments."""
    reads = aln(spark, sf_dir).withColumn("gene", F.expr("donor div 1500"))
    bounds = reads.select(*SITE, "gene", F.explode(F.array("donor", "acceptor")).alias("pos"))
    segs = iv.segments(bounds, [*SITE, "gene"])
    shapes = reads.groupBy(*SITE, "gene", "rs", "donor", "acceptor", "re").agg(F.count(F.lit(1)).alias("n"))
    met = shapes.join(segs, [*SITE, "gene"])
    covered = iv.shared_bases(("rs", "donor"), ("start", "end")) + iv.shared_bases(("acceptor", "re"), ("start", "end"))
    return met.where(covered * 2 >= F.col("end") - F.col("start")).groupBy(*SITE, "gene", "seg_idx").agg(F.sum("n").alias("n"))


Q_SEGMENT_FRACTION = f"""WITH {ALN}, b AS (SELECT DISTINCT * FROM (SELECT chrom, strand, donor // 1500 AS gene, donor AS pos FROM aln UNION ALL SELECT chrom, strand, donor // 1500, acceptor FROM aln)),
segs AS (SELECT * FROM (SELECT chrom, strand, gene, row_number() OVER w - 1 AS seg_idx, pos AS start, lead(pos) OVER w AS stop FROM b WINDOW w AS (PARTITION BY chrom, strand, gene ORDER BY pos)) WHERE stop IS NOT NULL)
SELECT s.chrom, s.strand, s.gene, seg_idx, count(*) AS n FROM aln a JOIN segs s ON s.chrom = a.chrom AND s.strand = a.strand AND s.gene = a.donor // 1500
WHERE (greatest(least(donor, stop) - greatest(rs, start), 0) + greatest(least(re, stop) - greatest(acceptor, start), 0)) * 2 >= stop - start GROUP BY 1, 2, 3, 4"""


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of regions of both strands that share over 0.4 of either: size and first start."""
    shared = iv.shared_bases(("start", "end"), ("r_start", "r_end"))
    ratio = F.greatest(shared / (F.col("end") - F.col("start")), shared / (F.col("r_end") - F.col("r_start")))
    code = lambda start, minus: F.conv(F.hex(F.substring("chrom", 4, 1)), 16, 10).cast("long") * (1 << 40) + F.col(start) * 2 + minus
    edges = _pairs(spark, sf_dir).where(ratio > 0.4).select(code("start", 0).alias("a"), code("r_start", 1).alias("b"))
    return components(edges).groupBy("label").agg(F.count(F.lit(1)).alias("size")).select(F.expr("(label % (1L << 40)) div 2").alias("start"), "size")


Q_COMPONENTS = f"""WITH RECURSIVE {ALN}, {_BLOCKS}, {_REGIONS}, {_PAIRS},
e AS (SELECT ascii(substr(chrom, 4, 1)) * 1099511627776 + start*2 AS a, ascii(substr(chrom, 4, 1)) * 1099511627776 + r_start*2 + 1 AS b FROM pairs WHERE greatest(shared / (stop - start), shared / (r_stop - r_start)) > 0.4),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a),
l AS (SELECT node, min(seen) AS label FROM r GROUP BY node)
SELECT CAST((label % 1099511627776) // 2 AS BIGINT) AS start, count(*) AS size FROM l GROUP BY label"""

QUERIES = [q_modal_length, q_genome_size, q_gene_spans, q_intron_union, q_lone_sites, q_extreme_sites, q_segment_fraction, q_components]
SQL = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
