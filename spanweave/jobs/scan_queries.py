"""Queries on scans of many regions, samples, and the elements of genes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import elements as el
from ..operators import intervals as iv
from ..operators import reads, regions
from ..sources import layout
from ..storage import new_folder
from .element_queries import _FLIPPED
from .interval_queries import _islands_sql
from .tables import ALN, aln

SITE, GENE = ["chrom", "strand"], ["chrom", "strand", "gene"]


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with what scans need: four samples, mates, qualities, query lengths."""
    rows = aln(spark, sf_dir).withColumn("gene", F.expr("donor div 1500")).withColumn("sample", F.expr("sample % 4"))
    return rows.withColumn("mapq", F.col("fl") * 10).withColumn("mate_start", F.expr("rs + 50 * (fl % 3)")).withColumn("qlen", F.col("re") - F.col("rs") - F.col("acceptor") + F.col("donor"))


_R = "r AS (SELECT chrom, strand, rs, donor, acceptor, re, sample % 4 AS sample, fl, name, flag, donor // 1500 AS gene, fl * 10 AS mapq, rs + 50 * (fl % 3) AS mate_start, re - rs - acceptor + donor AS qlen FROM aln)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches around each gene's middle."""
    genes = _reads(spark, sf_dir).groupBy(*GENE).agg(F.min("donor").alias("start"), F.max("acceptor").alias("end"))
    return genes


_SPANS = "g AS (SELECT chrom, strand, gene, min(donor) AS start, max(acceptor) AS stop FROM r GROUP BY 1, 2, 3)"


def q_region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.overlap_counts(_spans(spark, sf_dir).select("chrom", "start", "end").distinct(), _reads(spark, sf_dir))


Q_REGION_COUNTS = f"WITH {ALN}, {_R}, {_SPANS}, u AS (SELECT DISTINCT chrom, start, stop FROM g) SELECT u.chrom, start AS r_start, stop AS r_end, count(r.rs) AS n FROM u LEFT JOIN r ON r.chrom = u.chrom AND rs < stop AND start < re GROUP BY 1, 2, 3"


def q_region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads of each region, turned by the library's rule, by flag."""
    found = reads.library_flip(regions.scan(_spans(spark, sf_dir), _reads(spark, sf_dir)), 2)
    return found.groupBy("chrom", "r_start", "r_end", "r_strand", "flag").agg(F.sum("fl").alias("fl"))


Q_REGION_SCAN = f"WITH {ALN}, {_R}, {_SPANS} SELECT g.chrom, start AS r_start, stop AS r_end, g.strand AS r_strand, {_FLIPPED} AS flag, CAST(sum(fl) AS BIGINT) AS fl FROM g JOIN r ON r.chrom = g.chrom AND rs < stop AND start < re GROUP BY 1, 2, 3, 4, 5"


def q_stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of a third of the regions, from reads stored by place."""
    path = new_folder(spark, "stored-reads")
    layout.write_reads(_reads(spark, sf_dir).select("chrom", "rs", "re", "strand", "fl", "name"), path, 1 << 12)
    some = _spans(spark, sf_dir).where("gene % 3 = 0").select("chrom", "start", "end").distinct()
    return layout.scan_stored(some, path).groupBy("chrom", "r_start", "r_end", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("fl").alias("fl"))


Q_STORED_SCAN = f"WITH {ALN}, {_R}, {_SPANS} SELECT g.chrom, g.start AS r_start, g.stop AS r_end, r.strand, count(*) AS n, CAST(sum(fl) AS BIGINT) AS fl FROM (SELECT DISTINCT chrom, start, stop FROM g WHERE gene % 3 = 0) g JOIN r ON r.chrom = g.chrom AND rs < stop AND start < re GROUP BY 1, 2, 3, 4"


def q_region_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean reads wholly inside each region widened by 60, on its strand."""
    wide = _spans(spark, sf_dir).withColumn("start", F.col("start") - 60).withColumn("end", F.col("end") + 60)
    return regions.reads_inside(wide, _reads(spark, sf_dir)).groupBy("chrom", "r_start", "r_end", "r_strand").agg(F.count(F.lit(1)).alias("n"), F.sum("fl").alias("fl"))


Q_REGION_READS = f"""WITH {ALN}, {_R}, {_SPANS} SELECT g.chrom, start - 60 AS r_start, stop + 60 AS r_end, g.strand AS r_strand, count(*) AS n, CAST(sum(fl) AS BIGINT) AS fl FROM g JOIN r ON r.chrom = g.chrom AND rs >= start - 60 AND re <= stop + 60
WHERE flag & 256 = 0 AND re - rs - qlen < 100000 AND ((flag & 16) <> 0) <> ((flag & 32) <> 0) AND (g.strand = '-') = (flag & 16 <> 0) GROUP BY 1, 2, 3, 4"""


def q_mapped_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.mapped_numbers(_reads(spark, sf_dir), ["sample"])


Q_MAPPED_NUMBERS = f"WITH {ALN}, {_R} SELECT sample, count(*) FILTER (WHERE flag & 4 = 0) AS mapped FROM r GROUP BY 1"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reads(spark, sf_dir)
    sizes = rows.groupBy("chrom").agg(F.max("re").alias("length")).crossJoin(F.broadcast(rows.select("sample").distinct()))  # four samples
    return regions.sample_table(rows, sizes, ["rs", "re", "name", "fl", "flag", "qlen"])


def q_sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir)


_SAMPLES = """rates AS (SELECT sample, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, (SELECT sum(s) FROM (SELECT max(re) AS s FROM r GROUP BY chrom)) AS genome FROM r GROUP BY 1),
p(sample, l, k, term, total) AS (SELECT sample, mapped * 100.0 / genome, 0, exp(-mapped * 100.0 / genome), exp(-mapped * 100.0 / genome) FROM rates UNION ALL SELECT sample, l, k + 1, term * l / (k + 1), total + term * l / (k + 1) FROM p WHERE total < 0.99),
cuts AS (SELECT sample, CAST(max(k) AS BIGINT) AS cutoff FROM p GROUP BY 1)"""
Q_SAMPLE_TABLE = f"""WITH RECURSIVE {ALN}, {_R}, {_SAMPLES}, f AS (SELECT sample, qlen, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY rs, re, name, fl, flag, qlen) AS k FROM r) WHERE k <= 100 GROUP BY 1, 2),
m AS (SELECT sample, qlen AS length FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, qlen) AS k FROM f) WHERE k = 1)
SELECT sample, mapped, length, cutoff FROM rates JOIN m USING (sample) JOIN cuts USING (sample)"""


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.counted_bins(_reads(spark, sf_dir), ["sample", "chrom"])


def q_counted_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir)


_COUNTED = """k AS (SELECT *, lag(rs) OVER w = rs AND lag(mate_start) OVER w = mate_start AND (lag(flag) OVER w & 16) = (flag & 16) AS again FROM r WHERE mapq >= 20 AND flag & 3852 = 0 WINDOW w AS (PARTITION BY sample, chrom ORDER BY rs, mate_start, flag & 16, re)),
b AS (SELECT sample, chrom, bin, count(*) AS n FROM (SELECT sample, chrom, unnest(generate_series((rs - 1) // 100, (re - 2) // 100)) AS bin FROM k WHERE again IS NULL OR NOT again) GROUP BY 1, 2, 3)"""
Q_COUNTED_BINS = f"WITH {ALN}, {_R}, {_COUNTED} SELECT * FROM b"


def q_linkage_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample cut at its own background, then united."""
    return regions.linkage_regions(_bins(spark, sf_dir), _samples(spark, sf_dir))


Q_LINKAGE_BY_SAMPLE = f"""WITH RECURSIVE {ALN}, {_R}, {_SAMPLES}, {_COUNTED}, s AS (SELECT DISTINCT chrom, bin*100 + 1 AS start, bin*100 + 101 AS stop FROM b JOIN cuts USING (sample) WHERE n > cutoff)
SELECT chrom, start, stop AS "end" FROM ({_islands_sql("s", "chrom", "start", "stop", "start > m")})"""


def _depth(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    pair = F.explode(F.array(F.struct(F.col("rs").alias("start"), F.col("donor").alias("end")), F.struct(F.col("acceptor").alias("start"), F.col("re").alias("end"))))
    return iv.depth_runs(_reads(spark, sf_dir).select(*by, pair.alias("b")).select(*by, "b.*"), by)


def _depth_sql(by: str) -> str:
    return f"""blocks AS (SELECT {by}, rs AS start, donor AS stop FROM r UNION ALL SELECT {by}, acceptor, re FROM r),
depth AS (SELECT * FROM (SELECT {by}, pos AS start, lead(pos) OVER w AS stop, sum(s) OVER w AS depth FROM (SELECT {by}, pos, sum(s) AS s FROM (SELECT {by}, start AS pos, 1 AS s FROM blocks UNION ALL SELECT {by}, stop, -1 FROM blocks) GROUP BY ALL HAVING sum(s) <> 0) WINDOW w AS (PARTITION BY {by} ORDER BY pos)) WHERE depth > 0)"""


def q_depth_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each strand within each region of it."""
    return regions.depth_slices(_spans(spark, sf_dir), _depth(spark, sf_dir, SITE), SITE)


Q_DEPTH_SLICES = f"WITH {ALN}, {_R}, {_SPANS}, {_depth_sql('chrom, strand')} SELECT g.chrom, g.strand, g.start AS r_start, g.stop AS r_end, greatest(d.start, g.start) AS start, least(d.stop, g.stop) AS \"end\", CAST(depth AS BIGINT) AS depth FROM g JOIN depth d ON d.chrom = g.chrom AND d.strand = g.strand AND d.start < g.stop AND g.start < d.stop"


def _sites(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Ends of reads with an evidence of over 6, of each gene."""
    return el.site_votes(_reads(spark, sf_dir), GENE, kind).where("votes > 6").select(*GENE, "pos")


def q_site_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = [el.site_votes(_reads(spark, sf_dir), GENE, k).withColumn("kind", F.lit(k)) for k in ("start", "stop")]
    return iv.union_all(votes)


_VOTES = """v AS (SELECT chrom, strand, gene, CASE WHEN (strand = '-') = (kind = 'stop') THEN rs ELSE re END AS pos, kind, CAST(sum(fl) AS BIGINT) AS votes FROM r, (VALUES ('start'), ('stop')) AS t(kind) GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT chrom, strand, gene, pos, kind FROM v WHERE votes > 6)"""
Q_SITE_VOTES = f"WITH {ALN}, {_R}, {_VOTES} SELECT * FROM v"


def _introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns of three reads or more; those of over eight count as spliced."""
    found = _reads(spark, sf_dir).groupBy(*GENE, F.col("donor").alias("start"), F.col("acceptor").alias("end")).agg(F.count(F.lit(1)).alias("n"))
    return found.where("n > 2").withColumn("spliced", F.col("n") > 8)


_INTRONS = "i AS (SELECT chrom, strand, gene, donor AS start, acceptor AS stop, count(*) AS n, count(*) > 8 AS spliced FROM r GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 2)"


def q_first_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.first_exons(_sites(spark, sf_dir, "start"), _sites(spark, sf_dir, "stop"), _introns(spark, sf_dir), GENE)


def q_last_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.last_exons(_sites(spark, sf_dir, "start"), _sites(spark, sf_dir, "stop"), _introns(spark, sf_dir), GENE)


def _terminal_sql(kind: str) -> str:
    """Positions times the strand's sign d: everything is to the right there."""
    other, border = ("stop", "start, stop") if kind == "start" else ("start", "stop, start")
    plus, minus = border.split(", ")
    reach, pick = ("t.p - s.p", "min") if kind == "start" else ("s.p - t.p", "max")
    return f"""WITH {ALN}, {_R}, {_VOTES}, {_INTRONS}, t AS (SELECT chrom, strand, gene, CASE WHEN strand = '-' THEN -pos ELSE pos END AS p FROM s WHERE kind = '{other}' UNION SELECT chrom, strand, gene, CASE WHEN strand = '-' THEN -{minus} ELSE {plus} END FROM i),
o AS (SELECT chrom, strand, gene, CASE WHEN strand = '-' THEN -pos ELSE pos END AS p FROM s WHERE kind = '{kind}')
SELECT chrom, strand, gene, least(abs(p), abs(q)) AS start, greatest(abs(p), abs(q)) AS "end" FROM (SELECT s.chrom, s.strand, s.gene, s.p, {pick}(t.p) AS q FROM o s JOIN t ON t.chrom = s.chrom AND t.strand = s.strand AND t.gene = s.gene AND {reach} BETWEEN 3 AND 10000 GROUP BY 1, 2, 3, 4)"""


Q_FIRST_EXONS, Q_LAST_EXONS = _terminal_sql("start"), _terminal_sql("stop")


def q_inner_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.inner_exons(_introns(spark, sf_dir), GENE)


_INNER = """z AS (SELECT DISTINCT chrom, strand, gene, unnest([start, stop]) AS p FROM i WHERE spliced UNION SELECT DISTINCT chrom, strand, gene, 0 FROM i UNION SELECT DISTINCT chrom, strand, gene, 1000000000000 FROM i),
w AS (SELECT * FROM (SELECT chrom, strand, gene, p AS lo, lead(p) OVER (PARTITION BY chrom, strand, gene ORDER BY p) AS hi FROM z) WHERE hi IS NOT NULL),
x AS (SELECT DISTINCT w.chrom, w.strand, w.gene, a.stop AS start, b.start AS stop FROM w JOIN i a ON (a.chrom, a.strand, a.gene) = (w.chrom, w.strand, w.gene) AND a.stop BETWEEN lo AND hi JOIN i b ON (b.chrom, b.strand, b.gene) = (w.chrom, w.strand, w.gene) AND b.start BETWEEN lo AND hi WHERE b.start - a.stop BETWEEN 3 AND 10000)"""
Q_INNER_EXONS = f"WITH {ALN}, {_R}, {_INTRONS}, {_INNER} SELECT chrom, strand, gene, start, stop AS \"end\" FROM x"


def q_unused_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    introns = _introns(spark, sf_dir)
    starts, ends = el.unused_borders(introns, el.inner_exons(introns, GENE), GENE)
    return starts.withColumn("side", F.lit("start")).unionByName(ends.withColumn("side", F.lit("end")))


Q_UNUSED_BORDERS = f"WITH {ALN}, {_R}, {_INTRONS}, {_INNER} SELECT DISTINCT i.chrom, i.strand, i.gene, start AS pos, 'start' AS side FROM i WHERE (chrom, strand, gene, start) NOT IN (SELECT (chrom, strand, gene, stop) FROM x) UNION ALL SELECT DISTINCT i.chrom, i.strand, i.gene, stop, 'end' FROM i WHERE (chrom, strand, gene, stop) NOT IN (SELECT (chrom, strand, gene, start) FROM x)"


def q_gap_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner exons that the best of the samples covers but for 50 bases, two deep."""
    exons = el.inner_exons(_introns(spark, sf_dir), GENE)
    samples = _reads(spark, sf_dir).select("sample").distinct()
    depth = _depth(spark, sf_dir, [*SITE, "sample"])
    return el.without_gaps(exons, depth, SITE, samples, 2)


Q_GAP_BY_SAMPLE = f"""WITH {ALN}, {_R}, {_INTRONS}, {_INNER}, {_depth_sql('chrom, strand, sample')}, e AS (SELECT DISTINCT chrom, strand, start, stop FROM x),
c AS (SELECT chrom, strand, start, stop, max(deep) AS deep FROM (SELECT e.chrom, e.strand, e.start, e.stop, sample, sum(least(e.stop, d.stop) - greatest(e.start, d.start)) AS deep FROM e JOIN depth d ON d.chrom = e.chrom AND d.strand = e.strand AND d.start < e.stop AND e.start < d.stop AND depth >= 2 GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4)
SELECT x.chrom, x.strand, x.gene, x.start, x.stop AS "end" FROM x LEFT JOIN c USING (chrom, strand, start, stop) WHERE x.stop - x.start - coalesce(deep, 0) <= 50"""


def q_gene_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sites (those with over 8 votes), else annotated ones (genes of even numbers have their median end), and far ends."""
    rows = _reads(spark, sf_dir)
    out = []
    for kind in ("start", "stop"):
        votes = el.site_votes(rows, GENE, kind)
        known = votes.where("votes > 8").select(*GENE, "pos")
        noted = votes.where("gene % 2 = 0").groupBy(*GENE).agg(F.max_by("pos", F.struct("votes", "pos")).alias("pos"))
        out.append(el.gene_sites(known, noted, rows, GENE, kind, SMALL_REACH).withColumn("kind", F.lit(kind)))
    return iv.union_all(out)


SMALL_REACH = replace(DEFAULT, site_distance=30)
Q_GENE_SITES = f"""WITH {ALN}, {_R}, {_VOTES}, m AS (SELECT *, CASE WHEN strand = '-' THEN -pos ELSE pos END * CASE WHEN kind = 'stop' THEN 1 ELSE -1 END AS out_ FROM v),
known AS (SELECT chrom, strand, gene, kind, pos, out_ FROM m WHERE votes > 8),
noted AS (SELECT chrom, strand, gene, kind, pos, out_ FROM (SELECT *, row_number() OVER (PARTITION BY chrom, strand, gene, kind ORDER BY votes DESC, pos DESC) AS k FROM m WHERE gene % 2 = 0) WHERE k = 1 AND (chrom, strand, gene, kind) NOT IN (SELECT (chrom, strand, gene, kind) FROM known)),
a AS (SELECT * FROM known UNION ALL SELECT * FROM noted),
far AS (SELECT chrom, strand, gene, kind, max(out_) AS far_, arg_max(pos, out_) AS pos FROM m GROUP BY 1, 2, 3, 4),
edge AS (SELECT chrom, strand, gene, kind, max(out_) AS edge_ FROM a GROUP BY 1, 2, 3, 4)
SELECT chrom, strand, gene, kind, pos FROM a UNION ALL SELECT chrom, strand, gene, kind, pos FROM far LEFT JOIN edge USING (chrom, strand, gene, kind) WHERE edge_ IS NULL OR far_ - edge_ >= 30"""


def q_away_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of reads that lie 15 bases or more from every known one."""
    votes = el.site_votes(_reads(spark, sf_dir), GENE, "start")
    return el.away_from(votes.where("votes <= 8").select(*GENE, "pos"), votes.where("votes > 8"), GENE, 15)


Q_AWAY_SITES = f"WITH {ALN}, {_R}, {_VOTES} SELECT chrom, strand, gene, pos FROM v a WHERE kind = 'start' AND votes <= 8 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.kind = 'start' AND b.votes > 8 AND b.chrom = a.chrom AND b.strand = a.strand AND b.gene = a.gene AND abs(a.pos - b.pos) < 15)"


def q_genes_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes that have a first and a last exon."""
    first, last = q_first_exons(spark, sf_dir), q_last_exons(spark, sf_dir)
    return first.select(*GENE).distinct().join(last, GENE, "left_semi")


Q_GENES_WITH_ENDS = f"SELECT DISTINCT chrom, strand, gene FROM ({Q_FIRST_EXONS}) JOIN ({Q_LAST_EXONS}) USING (chrom, strand, gene)"


def q_sites_on_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites inside each gene's stretch, on its strand, both ends included."""
    spans = _spans(spark, sf_dir).withColumn("reach", F.col("end") + 1)
    sites = _sites(spark, sf_dir, "stop").select(*SITE, "pos", (F.col("pos") + 1).alias("pos_end")).distinct()
    met = iv.overlap_join(spans, sites, SITE, 1000, ("start", "reach"), ("pos", "pos_end"))
    return met.groupBy(*GENE).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


Q_SITES_ON_STRAND = f"WITH {ALN}, {_R}, {_VOTES}, {_SPANS}, u AS (SELECT DISTINCT chrom, strand, pos FROM s WHERE kind = 'stop') SELECT g.chrom, g.strand, g.gene, count(*) AS n, min(pos) AS first FROM g JOIN u ON u.chrom = g.chrom AND u.strand = g.strand AND pos BETWEEN start AND stop GROUP BY 1, 2, 3"


def q_moved_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads' blocks moved to the intron that is the commonest of their gene."""
    rows = _reads(spark, sf_dir)
    best = _introns(spark, sf_dir).groupBy(*GENE).agg(F.max_by(F.struct("start", "end"), F.struct("n", "start", "end")).alias("best"))
    pair = lambda s, e: F.struct(F.col(s).alias("start"), F.col(e).alias("end"))
    met = rows.groupBy(*GENE, "rs", "donor", "acceptor", "re").agg(F.count(F.lit(1)).alias("n")).join(best, GENE).where("rs <= best.end and re >= best.start")
    moved = el.moved_introns(F.array(pair("rs", "donor"), pair("acceptor", "re")), F.col("best.start"), F.col("best.end"))
    return met.select(*GENE, moved.alias("b"), "n").groupBy(*GENE, F.col("b")[0]["end"].alias("donor"), F.col("b")[1]["start"].alias("acceptor")).agg(F.sum("n").alias("n"))


Q_MOVED_INTRONS = f"""WITH {ALN}, {_R}, {_INTRONS}, best AS (SELECT chrom, strand, gene, start AS s, stop AS e FROM (SELECT *, row_number() OVER (PARTITION BY chrom, strand, gene ORDER BY n DESC, start DESC, stop DESC) AS k FROM i) WHERE k = 1),
m AS (SELECT chrom, strand, gene, re, acceptor, s, e, CASE WHEN rs < s AND s < acceptor THEN s ELSE donor END AS d, donor, CASE WHEN acceptor < s AND s < re THEN s ELSE re END AS stop2 FROM r JOIN best USING (chrom, strand, gene) WHERE rs <= e AND re >= s)
SELECT chrom, strand, gene, d AS donor, CASE WHEN donor < e AND e < stop2 THEN e ELSE acceptor END AS acceptor, count(*) AS n FROM m GROUP BY 1, 2, 3, 4, 5"""


QUERIES = [q_stored_scan, q_region_counts, q_region_scan, q_region_reads, q_mapped_numbers, q_sample_table, q_counted_bins, q_linkage_by_sample, q_depth_slices, q_site_votes, q_first_exons, q_last_exons, q_inner_exons, q_unused_borders, q_gap_by_sample, q_gene_sites, q_away_sites, q_genes_with_ends, q_sites_on_strand, q_moved_introns]
SQL = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
