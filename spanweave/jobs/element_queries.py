"""Queries on reads, junctions, sites, exons, segments and projected paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import paths, reads
from .tables import ALN, aln, table

SITE = ["chrom", "strand"]


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aln(spark, sf_dir).withColumn("qlen", F.col("re") - F.col("rs") - F.col("acceptor") + F.col("donor"))


def q_clean_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.clean_reads(_flagged(spark, sf_dir)).groupBy("chrom", "flag").agg(F.count(F.lit(1)).alias("n"))


Q_CLEAN_READS = f"WITH {ALN} SELECT chrom, flag, count(*) AS n FROM aln WHERE flag & 256 = 0 AND acceptor - donor < 100000 AND ((flag & 16) <> 0) <> ((flag & 32) <> 0) GROUP BY 1, 2"


def q_library_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.library_flip(aln(spark, sf_dir), 2).groupBy("chrom", "flag").agg(F.count(F.lit(1)).alias("n"))


_FLIPPED = "CASE WHEN flag & 128 <> 0 THEN xor(flag, 48) ELSE flag END"
Q_LIBRARY_FLIP = f"WITH {ALN} SELECT chrom, {_FLIPPED} AS flag, count(*) AS n FROM aln GROUP BY 1, 2"


def q_flip_then_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientation first, cleaning after it: a proper pair stays one."""
    return reads.clean_reads(reads.library_flip(_flagged(spark, sf_dir), 2)).groupBy("chrom", "flag").agg(F.count(F.lit(1)).alias("n"))


Q_FLIP_THEN_CLEAN = f"WITH {ALN} SELECT chrom, flag, count(*) AS n FROM (SELECT chrom, acceptor - donor AS gap, {_FLIPPED} AS flag FROM aln) WHERE flag & 256 = 0 AND gap < 100000 AND ((flag & 16) <> 0) <> ((flag & 32) <> 0) GROUP BY 1, 2"


def q_fl_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("fl") > 2, F.concat(F.lit("c1/f"), F.col("fl").cast("string"), F.lit("p0/900"))).otherwise(F.col("name"))
    return aln(spark, sf_dir).select("chrom", reads.full_length_count(name).alias("fl")).groupBy("chrom", "fl").agg(F.count(F.lit(1)).alias("n"))


Q_FL_REGEX = f"WITH {ALN} SELECT chrom, coalesce(try_cast(nullif(regexp_extract(CASE WHEN fl > 2 THEN 'c1/f' || CAST(fl AS VARCHAR) || 'p0/900' ELSE name END, '[+\\w]+/f(\\d+)p\\d+/\\d+', 1), '') AS BIGINT), 1) AS fl, count(*) AS n FROM aln GROUP BY 1, 2"


def _with_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda s, e: F.struct(F.col(s).alias("start"), F.col(e).alias("end"))
    return aln(spark, sf_dir).withColumn("blocks", F.array(pair("rs", "donor"), pair("acceptor", "re")))


def q_introns_from_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_blocks(spark, sf_dir).select("chrom", "strand", F.explode(reads.introns(F.col("blocks"))).alias("i"))
    return rows.groupBy("chrom", "strand", "i.start", "i.end").agg(F.count(F.lit(1)).alias("n"))


Q_INTRONS_FROM_BLOCKS = f"WITH {ALN} SELECT chrom, strand, donor AS start, acceptor AS \"end\", count(*) AS n FROM aln GROUP BY 1, 2, 3, 4"


def q_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_blocks(spark, sf_dir).select("chrom", reads.blocks_to_cigar(F.col("blocks")).alias("cigar")).groupBy("chrom", "cigar").agg(F.count(F.lit(1)).alias("n"))


Q_CIGAR = f"WITH {ALN} SELECT chrom, concat(donor - rs, 'M', acceptor - donor, 'N', re - acceptor, 'M') AS cigar, count(*) AS n FROM aln GROUP BY 1, 2"


def q_flanked_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps whose sides hold eight matched bases before any other op: a deletion stands fl + 3
    bases before each gap."""
    op = lambda code, n: F.struct(F.lit(code).alias("op"), n.cast("long").alias("len"))
    cigar = F.array(op(0, F.col("donor") - F.col("rs") - 12), op(2, 9 - F.col("fl")), op(0, F.col("fl") + 3), op(3, F.col("acceptor") - F.col("donor")), op(0, F.col("re") - F.col("acceptor")))
    rows = aln(spark, sf_dir).select("chrom", F.explode(reads.junctions(cigar, F.col("rs"))).alias("j"))
    return rows.groupBy("chrom", "j.start", "j.end").agg(F.count(F.lit(1)).alias("n"))


Q_FLANKED_JUNCTIONS = f"WITH {ALN} SELECT chrom, donor AS start, acceptor AS \"end\", count(*) AS n FROM aln WHERE fl + 3 >= 8 GROUP BY 1, 2, 3"


def q_junction_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.junction_support(aln(spark, sf_dir), SITE)


Q_JUNCTION_SUPPORT = f"WITH {ALN} SELECT chrom, strand, donor, acceptor, count(*) AS support FROM aln GROUP BY 1, 2, 3, 4"


def q_junction_support_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.junction_support(aln(spark, sf_dir), SITE, "name")


Q_JUNCTION_SUPPORT_PAIRED = f"WITH {ALN} SELECT chrom, strand, donor, acceptor, count(DISTINCT name) AS support FROM aln GROUP BY 1, 2, 3, 4"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.junction_support(aln(spark, sf_dir), SITE)


def q_junction_filter_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.filter_pass(_edges(spark, sf_dir), SITE, 2, 5, 0.2)


Q_JUNCTION_FILTER_PASS = f"""WITH {ALN}, e AS (SELECT chrom, strand, donor, acceptor, count(*) AS support FROM aln GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
x AS (SELECT *, sum(support) OVER (PARTITION BY chrom, strand, donor) AS d, sum(support) OVER (PARTITION BY chrom, strand, acceptor) AS a FROM e)
SELECT chrom, strand, donor, acceptor, support FROM x WHERE d >= 5 AND a >= 5 AND support / greatest(d, a) >= 0.2"""


def q_junction_filter_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-dependent filter to its fixpoint, a gene (a block of parts) at a time."""
    edges = _edges(spark, sf_dir).withColumn("gene", F.expr("donor div 1500"))
    return paths.filter_junctions(edges, [*SITE, "gene"])


def q_psi_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of spliced reads of each junction against the depth at its first and last base."""
    junctions = _edges(spark, sf_dir)
    pair = F.explode(F.array(F.struct(F.col("rs").alias("start"), F.col("donor").alias("end")), F.struct(F.col("acceptor").alias("start"), F.col("re").alias("end"))))
    depth = iv.depth_runs(aln(spark, sf_dir).select("chrom", "strand", pair.alias("b")).select("chrom", "strand", "b.*"), SITE)
    at = junctions.select(*SITE, "donor", "acceptor", "support", F.explode(F.array(F.col("donor"), F.col("acceptor") - 1)).alias("p")).withColumn("p_end", F.col("p") + 1)
    met = iv.overlap_join(at, depth, SITE, 1000, ("p", "p_end"), ("start", "end")).select(*SITE, "donor", "acceptor", "p", "depth")
    whole = at.join(met, [*SITE, "donor", "acceptor", "p"], "left").groupBy(*SITE, "donor", "acceptor", "support").agg((F.sum(F.coalesce("depth", F.lit(0))) / 2).alias("kept"))
    psi = F.col("support") / (F.col("support") + F.col("kept"))
    return whole.select(*SITE, "donor", "acceptor", F.round(psi, 6).alias("psi"), (1 - psi < 0.3).alias("spliced"))


Q_PSI_SPLICED = f"""WITH {ALN}, blocks AS (SELECT chrom, strand, rs AS start, donor AS stop FROM aln UNION ALL SELECT chrom, strand, acceptor, re FROM aln),
depth AS (SELECT * FROM (SELECT chrom, strand, pos AS start, lead(pos) OVER w AS stop, sum(s) OVER w AS depth FROM (SELECT chrom, strand, pos, sum(s) AS s FROM (SELECT chrom, strand, start AS pos, 1 AS s FROM blocks UNION ALL SELECT chrom, strand, stop, -1 FROM blocks) GROUP BY 1, 2, 3 HAVING sum(s) <> 0) WINDOW w AS (PARTITION BY chrom, strand ORDER BY pos)) WHERE depth > 0),
j AS (SELECT chrom, strand, donor, acceptor, count(*) AS support FROM aln GROUP BY 1, 2, 3, 4),
k AS (SELECT j.*, (coalesce(a.depth, 0) + coalesce(b.depth, 0)) / 2 AS kept FROM j
 LEFT JOIN depth a ON a.chrom = j.chrom AND a.strand = j.strand AND a.start <= donor AND donor < a.stop
 LEFT JOIN depth b ON b.chrom = j.chrom AND b.strand = j.strand AND b.start <= acceptor - 1 AND acceptor - 1 < b.stop)
SELECT chrom, strand, donor, acceptor, round(support / (support + kept), 6) AS psi, 1 - support / (support + kept) < 0.3 AS spliced FROM k"""


def q_strand_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene blocks of a strand that hold at least half of the evidence of all strands there."""
    votes = aln(spark, sf_dir).groupBy("chrom", F.expr("donor div 1500").alias("gene"), "strand").agg(F.sum("fl").alias("fl"))
    total = votes.groupBy("chrom", "gene").agg(F.sum("fl").alias("total"))
    return votes.join(total, ["chrom", "gene"]).where("fl * 2 >= total")


Q_STRAND_VOTE = f"WITH {ALN} SELECT * FROM (SELECT chrom, donor // 1500 AS gene, strand, CAST(sum(fl) AS BIGINT) AS fl, CAST(sum(sum(fl)) OVER (PARTITION BY chrom, donor // 1500) AS BIGINT) AS total FROM aln GROUP BY 1, 2, 3) WHERE fl * 2 >= total"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read starts, as sites."""
    return aln(spark, sf_dir).select(*SITE, F.col("rs").alias("pos")).distinct()


def q_tss_exon_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each start site with the nearest donor 30 to 200 bases on."""
    targets = aln(spark, sf_dir).select(*SITE, F.col("donor").alias("pos"))
    return iv.nearest_after(_sites(spark, sf_dir), targets, SITE, 30, 200).withColumnRenamed("target", "exon_end")


Q_TSS_EXON_ASOF = f"WITH {ALN}, s AS (SELECT DISTINCT chrom, strand, rs AS pos FROM aln), t AS (SELECT DISTINCT chrom, strand, donor FROM aln) SELECT s.chrom, s.strand, pos, min(donor) AS exon_end FROM s LEFT JOIN t ON s.chrom = t.chrom AND s.strand = t.strand AND donor BETWEEN pos + 30 AND pos + 200 GROUP BY 1, 2, 3"


def q_tes_exon_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each end site with the nearest acceptor 25 to 90 bases before."""
    rows = aln(spark, sf_dir)
    ends = rows.select(*SITE, F.col("re").alias("pos")).distinct()
    return iv.nearest_before(ends, rows.select(*SITE, F.col("acceptor").alias("pos")), SITE, 25, 90).withColumnRenamed("target", "exon_start")


Q_TES_EXON_ASOF = f"WITH {ALN}, s AS (SELECT DISTINCT chrom, strand, re AS pos FROM aln), t AS (SELECT DISTINCT chrom, strand, acceptor FROM aln) SELECT s.chrom, s.strand, pos, max(acceptor) AS exon_start FROM s LEFT JOIN t ON s.chrom = t.chrom AND s.strand = t.strand AND acceptor BETWEEN pos - 90 AND pos - 25 GROUP BY 1, 2, 3"


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = aln(spark, sf_dir).groupBy(*SITE, F.expr("donor div 1500").alias("gene"))
    return spans.agg(F.min("rs").alias("g_start"), F.max("re").alias("g_end"))


_GENES = "genes AS (SELECT chrom, strand, donor // 1500 AS gene, min(rs) AS g_start, max(re) AS g_end FROM aln GROUP BY 1, 2, 3)"


def q_sites_in_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donor sites of either strand inside each gene, both ends included."""
    donors = aln(spark, sf_dir).select("chrom", F.col("donor").alias("site"), (F.col("donor") + 1).alias("site_end")).distinct()
    genes = _genes(spark, sf_dir).withColumn("reach", F.col("g_end") + 1)
    met = iv.overlap_join(genes, donors, ["chrom"], 1000, ("g_start", "reach"), ("site", "site_end"))
    return met.groupBy(*SITE, "gene").agg(F.count(F.lit(1)).alias("n_sites"), F.min("site").alias("first_site"))


Q_SITES_IN_GENE = f"WITH {ALN}, {_GENES}, s AS (SELECT DISTINCT chrom, donor AS site FROM aln) SELECT g.chrom, g.strand, gene, count(*) AS n_sites, min(site) AS first_site FROM genes g JOIN s ON g.chrom = s.chrom AND site BETWEEN g_start AND g_end GROUP BY 1, 2, 3"


def _exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptor to donor pairs of a gene that stand 3 to 10,000 bases apart."""
    rows = aln(spark, sf_dir).withColumn("gene", F.expr("donor div 1500"))
    begins, stops = (rows.select(*SITE, "gene", F.col(c).alias(c)).distinct() for c in ("acceptor", "donor"))
    return begins.join(stops, [*SITE, "gene"]).where("donor - acceptor between 3 and 10000")


def q_exon_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exons(spark, sf_dir).select(*SITE, F.col("acceptor").alias("start"), F.col("donor").alias("end"))


_EXONS = "g AS (SELECT DISTINCT chrom, strand, donor // 1500 AS gene, donor, acceptor FROM aln), exons AS (SELECT DISTINCT a.chrom, a.strand, a.gene, a.acceptor, d.donor FROM g a JOIN g d ON a.chrom = d.chrom AND a.strand = d.strand AND a.gene = d.gene AND d.donor - a.acceptor BETWEEN 3 AND 10000)"
Q_EXON_ENUMERATION = f"WITH {ALN}, {_EXONS} SELECT chrom, strand, acceptor AS start, donor AS \"end\" FROM exons"


def q_unused_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptors that begin no enumerated exon."""
    acceptors = aln(spark, sf_dir).select(*SITE, "acceptor").distinct()
    return acceptors.join(_exons(spark, sf_dir).select(*SITE, "acceptor"), [*SITE, "acceptor"], "left_anti")


Q_UNUSED_JUNCTIONS = f"WITH {ALN}, {_EXONS} SELECT DISTINCT chrom, strand, acceptor FROM aln EXCEPT SELECT chrom, strand, acceptor FROM exons"


def q_txs_local_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start sites with the most evidence within 50 bases."""
    votes = aln(spark, sf_dir).groupBy(*SITE, F.col("rs").alias("pos")).agg(F.sum("fl").alias("votes"))
    return iv.local_maxima(votes, SITE, "pos", "votes", 50)


Q_TXS_LOCAL_MAX = f"""WITH {ALN}, v AS (SELECT chrom, strand, rs AS pos, CAST(sum(fl) AS BIGINT) AS votes FROM aln GROUP BY 1, 2, 3)
SELECT chrom, strand, pos, votes FROM (SELECT *, max(votes) OVER (PARTITION BY chrom, strand ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS top, max(votes) OVER (PARTITION BY chrom, strand ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 1 PRECEDING) AS earlier FROM v) WHERE votes = top AND (earlier IS NULL OR earlier < votes)"""


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aln(spark, sf_dir)
    return rows.select(*SITE, F.expr("donor div 1500").alias("gene"), F.explode(F.array("donor", "acceptor")).alias("pos"))


def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.segments(_bounds(spark, sf_dir), [*SITE, "gene"])


_SEGS = "b AS (SELECT DISTINCT * FROM (SELECT chrom, strand, donor // 1500 AS gene, donor AS pos FROM aln UNION ALL SELECT chrom, strand, donor // 1500, acceptor FROM aln)), segs AS (SELECT * FROM (SELECT chrom, strand, gene, row_number() OVER w - 1 AS seg_idx, pos AS start, lead(pos) OVER w AS stop FROM b WINDOW w AS (PARTITION BY chrom, strand, gene ORDER BY pos)) WHERE stop IS NOT NULL)"
Q_SEGMENTS = f"WITH {ALN}, {_SEGS} SELECT chrom, strand, gene, seg_idx, start, stop AS \"end\" FROM segs"


def _introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aln(spark, sf_dir).select(*SITE, F.expr("donor div 1500").alias("gene"), F.col("donor").alias("start"), F.col("acceptor").alias("end"))
    return rows.groupBy(*SITE, "gene", "start", "end").agg(F.count(F.lit(1)).alias("n"))


def q_element_seg_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.segment_index(_introns(spark, sf_dir), q_segments(spark, sf_dir), [*SITE, "gene"])


Q_ELEMENT_SEG_INDEX = f"WITH {ALN}, {_SEGS} SELECT i.chrom, i.strand, i.gene, i.donor AS start, i.acceptor AS \"end\", n, f.seg_idx AS first_seg, l.seg_idx AS last_seg FROM (SELECT chrom, strand, donor // 1500 AS gene, donor, acceptor, count(*) AS n FROM aln GROUP BY 1, 2, 3, 4, 5) i JOIN segs f ON (f.chrom, f.strand, f.gene, f.start) = (i.chrom, i.strand, i.gene, i.donor) JOIN segs l ON (l.chrom, l.strand, l.gene, l.stop) = (i.chrom, i.strand, i.gene, i.acceptor)"


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each intron's path over its gene's segments: 0 inside the intron, 1 elsewhere."""
    segs = q_segments(spark, sf_dir).groupBy(*SITE, "gene").agg(F.count(F.lit(1)).alias("n_segs"))
    inside = lambda i: F.when((i >= F.col("first_seg")) & (i <= F.col("last_seg")), 0).otherwise(1)
    rows = q_element_seg_index(spark, sf_dir).join(segs, [*SITE, "gene"])
    return rows.withColumn("segary", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_segs") - 1), inside))


def q_isoform_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by gene with their evidence, ends and flags."""
    rows = _projected(spark, sf_dir).groupBy(*SITE, "gene", "segary").agg(F.sum("n").alias("fl"))
    tagged = paths.tag(rows)
    return tagged.select(*SITE, "gene", F.array_join("segary", "").alias("path"), "fl", "sidx", "eidx", "invalid")


Q_ISOFORM_TAG = f"""WITH {ALN}, {_SEGS}, ns AS (SELECT chrom, strand, gene, count(*) AS k FROM segs GROUP BY 1, 2, 3),
i AS (SELECT a.chrom, a.strand, a.gene, n, f.seg_idx AS fs, l.seg_idx AS ls FROM (SELECT chrom, strand, donor // 1500 AS gene, donor, acceptor, count(*) AS n FROM aln GROUP BY 1, 2, 3, 4, 5) a JOIN segs f ON (f.chrom, f.strand, f.gene, f.start) = (a.chrom, a.strand, a.gene, a.donor) JOIN segs l ON (l.chrom, l.strand, l.gene, l.stop) = (a.chrom, a.strand, a.gene, a.acceptor)),
p AS (SELECT chrom, strand, gene, repeat('1', CAST(fs AS INTEGER)) || repeat('0', CAST(ls - fs + 1 AS INTEGER)) || repeat('1', CAST(k - ls - 1 AS INTEGER)) AS path, CAST(sum(n) AS BIGINT) AS fl FROM i JOIN ns USING (chrom, strand, gene) GROUP BY 1, 2, 3, 4)
SELECT *, CASE WHEN strpos(path, '1') > 0 THEN CAST(strpos(path, '1') - 1 AS INTEGER) END AS sidx, CASE WHEN strpos(path, '1') > 0 THEN CAST(length(path) - strpos(reverse(path), '1') AS INTEGER) END AS eidx, FALSE AS invalid FROM p"""


def q_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive parts that each supplier delivers."""
    return iv.runs(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey")


Q_RUNS = "SELECT l_suppkey, min(p) AS first, max(p) AS last FROM (SELECT l_suppkey, p, p - row_number() OVER (PARTITION BY l_suppkey ORDER BY p) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey AS p FROM lineitem)) GROUP BY l_suppkey, g"


def q_subpath_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns of a gene that no longer intron with an equal end covers."""
    rows = _introns(spark, sf_dir).select(*SITE, "gene", "start", "end")
    top = rows.groupBy(*SITE, "gene", "end").agg(F.min("start").alias("start"))
    return rows.join(top, [*SITE, "gene", "end", "start"], "left_semi")


Q_SUBPATH_ANTI = f"WITH {ALN}, i AS (SELECT DISTINCT chrom, strand, donor // 1500 AS gene, donor AS start, acceptor AS stop FROM aln) SELECT chrom, strand, gene, start, stop AS \"end\" FROM i WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.chrom = i.chrom AND j.strand = i.strand AND j.gene = i.gene AND j.stop = i.stop AND j.start < i.start)"


def q_seg_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each sample across each segment border of a gene: spliced over it, or through it."""
    rows = aln(spark, sf_dir).withColumn("gene", F.expr("donor div 1500"))
    segs = q_segments(spark, sf_dir).select(*SITE, "gene", F.col("start").alias("border"))
    spliced = rows.groupBy(*SITE, "gene", F.expr("sample % 4").alias("lane"), F.col("donor").alias("border")).agg(F.count(F.lit(1)).alias("spliced"))
    counts = rows.select(*SITE, "gene", F.expr("sample % 4").alias("lane"), "rs", "donor", "acceptor", "re").groupBy(*SITE, "gene", "lane", "rs", "donor", "acceptor", "re").agg(F.count(F.lit(1)).alias("n"))
    through = counts.join(segs, [*SITE, "gene"]).where("(rs < border and border < donor) or (acceptor < border and border < re)")
    through = through.groupBy(*SITE, "gene", "lane", "border").agg(F.sum("n").alias("through"))
    both = spliced.join(segs, [*SITE, "gene", "border"]).join(through, [*SITE, "gene", "lane", "border"], "full_outer")
    return both.select(*SITE, "gene", "lane", "border", F.coalesce("spliced", F.lit(0)).alias("spliced"), F.coalesce("through", F.lit(0)).alias("through"))


Q_SEG_LINK_COUNTS = f"""WITH {ALN}, {_SEGS}, r AS (SELECT *, donor // 1500 AS gene, sample % 4 AS lane FROM aln),
s AS (SELECT r.chrom, r.strand, r.gene, lane, donor AS border, count(*) AS spliced FROM r JOIN segs g ON g.chrom = r.chrom AND g.strand = r.strand AND g.gene = r.gene AND g.start = r.donor GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT r.chrom, r.strand, r.gene, lane, g.start AS border, count(*) AS through FROM r JOIN segs g ON g.chrom = r.chrom AND g.strand = r.strand AND g.gene = r.gene AND ((rs < g.start AND g.start < donor) OR (acceptor < g.start AND g.start < re)) GROUP BY 1, 2, 3, 4, 5)
SELECT chrom, strand, gene, lane, border, CAST(coalesce(spliced, 0) AS BIGINT) AS spliced, CAST(coalesce(through, 0) AS BIGINT) AS through FROM s FULL OUTER JOIN t USING (chrom, strand, gene, lane, border)"""


def q_intron_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders by the vote of their lanes: spliced, retained or both."""
    phi = (F.col("spliced") + 0.5) / (F.col("spliced") + F.col("through") + 1)
    votes = q_seg_link_counts(spark, sf_dir).groupBy(*SITE, "gene", "border").agg(F.sum((phi > 0.7).cast("int")).alias("i"), F.sum((phi < 0.3).cast("int")).alias("r"), F.sum(((phi >= 0.3) & (phi <= 0.7)).cast("int")).alias("b"))
    most = F.greatest("i", "r", "b")
    return votes.select(*SITE, "gene", "border", F.when(F.col("i") == most, "intron").when(F.col("r") == most, "retained").otherwise("both").alias("kind"))


Q_INTRON_TYPE = f"""SELECT chrom, strand, gene, border, CASE WHEN i = greatest(i, r, b) THEN 'intron' WHEN r = greatest(i, r, b) THEN 'retained' ELSE 'both' END AS kind FROM (
SELECT chrom, strand, gene, border, sum(CASE WHEN phi > 0.7 THEN 1 ELSE 0 END) AS i, sum(CASE WHEN phi < 0.3 THEN 1 ELSE 0 END) AS r, sum(CASE WHEN phi BETWEEN 0.3 AND 0.7 THEN 1 ELSE 0 END) AS b
FROM (SELECT *, (spliced + 0.5::DOUBLE) / (spliced + through + 1) AS phi FROM ({Q_SEG_LINK_COUNTS})) GROUP BY 1, 2, 3, 4)"""


def q_splice_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splice-pair priority of each document's first and last two letters."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(reads.splice_priority(F.substring(text, 1, 2), F.substring(text, -2, 2)).alias("priority"), F.substring(reads.reverse_complement(F.regexp_replace(text, "[^ACGTNacgtn]", "")), 1, 2).alias("last_pair"))
    return rows.groupBy("priority", "last_pair").agg(F.count(F.lit(1)).alias("n"))


_PAIR = "upper(left(coalesce(text, ''), 2)) || '-' || upper(right(coalesce(text, ''), 2))"
Q_SPLICE_PRIORITY = f"SELECT CASE {_PAIR} WHEN 'GT-AG' THEN 3 WHEN 'GC-AG' THEN 2 WHEN 'AT-AC' THEN 1 ELSE 0 END AS priority, left(reverse(translate(upper(regexp_replace(coalesce(text, ''), '[^ACGTNacgtn]', '', 'g')), 'ACGTN', 'TGCAN')), 2) AS last_pair, count(*) AS n FROM documents GROUP BY 1, 2"


def q_bed6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED6 lines of the introns, numbered within their gene."""
    return paths.bed6_lines(_introns(spark, sf_dir), [*SITE, "gene"], "intron")


Q_BED6 = f"WITH {ALN}, i AS (SELECT DISTINCT chrom, strand, donor // 1500 AS gene, donor, acceptor FROM aln) SELECT concat_ws(chr(9), chrom, donor, acceptor, 'g' || CAST(gene AS VARCHAR) || '_intron_' || CAST(row_number() OVER (PARTITION BY chrom, strand, gene ORDER BY donor, acceptor) AS VARCHAR), '0', strand) AS line FROM i"


def q_bed12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED12 lines of the distinct reads of two blocks."""
    return paths.bed12_lines(_with_blocks(spark, sf_dir).select(*SITE, "name", "blocks").distinct())


Q_BED12 = f"WITH {ALN} SELECT DISTINCT concat_ws(chr(9), chrom, rs, re, name, '0', strand, rs, rs, '0,0,0', '2', concat(donor - rs, ',', re - acceptor, ','), concat('0,', acceptor - rs, ',')) AS line FROM aln"


def q_path_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chains of nearest introns of each gene, or its status where there are too many."""
    found = paths.enumerate_paths(_introns(spark, sf_dir).where("n > 1"), [*SITE, "gene"])
    return found.withColumn("path", F.array_join("path", " "))


Q_PATH_ENUM = f"""WITH RECURSIVE {ALN}, i AS (SELECT chrom, strand, donor // 1500 AS gene, donor AS s, acceptor AS e FROM aln GROUP BY ALL HAVING count(*) > 1),
f AS (SELECT i.*, (SELECT min(o.e) FROM i o WHERE (o.chrom, o.strand, o.gene) = (i.chrom, i.strand, i.gene) AND o.s >= i.e) AS next_end, min(e) OVER (PARTITION BY chrom, strand, gene) AS least FROM i),
p AS (SELECT chrom, strand, gene, e, next_end, concat(s, ':', e) AS path FROM f WHERE s < least
 UNION ALL SELECT p.chrom, p.strand, p.gene, f.e, f.next_end, concat(p.path, ' ', f.s, ':', f.e) FROM p JOIN f ON (f.chrom, f.strand, f.gene) = (p.chrom, p.strand, p.gene) AND f.s >= p.e AND f.s < p.next_end),
w AS (SELECT *, count(*) OVER (PARTITION BY chrom, strand, gene) AS k FROM p WHERE next_end IS NULL)
SELECT DISTINCT chrom, strand, gene, CASE WHEN k > 200 THEN 'too many' ELSE 'ok' END AS status, CASE WHEN k > 200 THEN '' ELSE path END AS path FROM w"""


def q_clique_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal cliques of overlapping introns of each gene."""
    return iv.cliques(_introns(spark, sf_dir), [*SITE, "gene"])


Q_CLIQUE_MERGE = f"""WITH {ALN}, i AS (SELECT DISTINCT chrom, strand, donor // 1500 AS gene, donor AS s, acceptor AS e FROM aln),
c AS (SELECT chrom, strand, gene, e, (SELECT max(s) FROM i o WHERE (o.chrom, o.strand, o.gene) = (x.chrom, x.strand, x.gene) AND o.s < x.e) AS s FROM (SELECT DISTINCT chrom, strand, gene, e FROM i) x),
m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM i o WHERE (o.chrom, o.strand, o.gene) = (c.chrom, c.strand, c.gene) AND c.s < o.e AND o.e < c.e))
SELECT m.chrom, m.strand, m.gene, dense_rank() OVER (PARTITION BY m.chrom, m.strand, m.gene ORDER BY m.e) - 1 AS clique, m.s AS start, m.e AS "end", count(*) AS size FROM m JOIN i ON (i.chrom, i.strand, i.gene) = (m.chrom, m.strand, m.gene) AND i.s <= m.s AND i.e >= m.e GROUP BY m.chrom, m.strand, m.gene, m.s, m.e"""


def q_clique_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns of a gene that are in the same maximal cliques: the first and the last of these, how many introns."""
    found = iv.clique_runs(_introns(spark, sf_dir), [*SITE, "gene"])
    return found.groupBy(*SITE, "gene", "first_clique", "last_clique").agg(F.count(F.lit(1)).alias("n"))


Q_CLIQUE_GROUPS = f"""WITH k AS ({Q_CLIQUE_MERGE}), {ALN}, i AS (SELECT DISTINCT chrom, strand, donor // 1500 AS gene, donor AS s, acceptor AS e FROM aln),
g AS (SELECT i.chrom, i.strand, i.gene, i.s, i.e, min(clique) AS first_clique, max(clique) AS last_clique FROM i JOIN k ON (k.chrom, k.strand, k.gene) = (i.chrom, i.strand, i.gene) AND k.start >= i.s AND k."end" <= i.e GROUP BY 1, 2, 3, 4, 5)
SELECT chrom, strand, gene, first_clique, last_clique, count(*) AS n FROM g GROUP BY ALL"""


QUERIES = [q_clean_reads, q_library_flip, q_flip_then_clean, q_fl_regex, q_introns_from_blocks, q_cigar, q_flanked_junctions, q_junction_support, q_junction_support_paired, q_junction_filter_pass, q_junction_filter_fixpoint, q_psi_spliced, q_strand_vote, q_tss_exon_asof, q_tes_exon_asof, q_sites_in_gene, q_exon_enumeration, q_unused_junctions, q_txs_local_max, q_segments, q_element_seg_index, q_isoform_tag, q_runs, q_subpath_anti, q_seg_link_counts, q_intron_type, q_splice_priority, q_bed6, q_bed12, q_path_enum, q_clique_merge, q_clique_groups]
SQL = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES if f.__name__.upper() in globals()}
