"""Queries on clusters of reads, the vote of their strands, and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import genes
from ..operators import intervals as iv
from ..storage import cut
from .tables import ALN, aln

KEYS = ["chrom", "strand"]


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with rounded ends; those of a supplier over seven in ten are not spliced."""
    rows = aln(spark, sf_dir).withColumn("a", F.expr("rs - rs % 40")).withColumn("z", F.expr("acceptor + 20 + 40 * (fl div 4)")).withColumn("whole", F.expr("sample % 10 > 6"))
    rows = rows.groupBy(*KEYS, "a", "donor", "acceptor", "z", "whole").agg(F.sum("fl").alias("fl"))
    code = F.expr("((a * 128 + donor - a) * 16 + (acceptor - donor) div 100) * 128 + (z - acceptor) div 20 * 32 + ascii(substr(chrom, 4, 1)) % 8 * 4 + int(strand = '-') * 2 + int(whole)")
    block = lambda s, e: F.struct(F.col(s).alias("start"), F.col(e).alias("end"))
    blocks = F.when(F.col("whole"), F.array(block("acceptor", "z"))).otherwise(F.array(block("a", "donor"), block("acceptor", "z")))
    return rows.select(code.alias("read"), *KEYS, blocks.alias("blocks"), "fl")


_READS = """q AS (SELECT ((a * 128 + donor - a) * 16 + (acceptor - donor) // 100) * 128 + (z - acceptor) // 20 * 32 + ascii(substr(chrom, 4, 1)) % 8 * 4 + CAST(strand = '-' AS INTEGER) * 2 + CAST(whole AS INTEGER) AS read, *, CASE WHEN whole THEN acceptor ELSE a END AS lo, CASE WHEN whole THEN z - acceptor ELSE z - acceptor + donor - a END AS size
 FROM (SELECT chrom, strand, rs - rs % 40 AS a, donor, acceptor, acceptor + 20 + 40 * (fl // 4) AS z, sample % 10 > 6 AS whole, donor // 1500 AS gene, CAST(sum(fl) AS BIGINT) AS fl FROM aln GROUP BY ALL)),
k AS (SELECT read, chrom, strand, gene, size, a AS s, donor AS e FROM q WHERE NOT whole UNION ALL SELECT read, chrom, strand, gene, size, acceptor, z FROM q),
o AS (SELECT x.read AS a, y.read AS b, x.strand = y.strand AS same, sum(least(x.e, y.e) - greatest(x.s, y.s)) / any_value(x.size) AS ratio_a, sum(least(x.e, y.e) - greatest(x.s, y.s)) / any_value(y.size) AS ratio_b FROM k x JOIN k y ON x.chrom = y.chrom AND x.gene = y.gene AND x.read < y.read AND x.s < y.e AND y.s < x.e GROUP BY 1, 2, 3)"""
_CLUSTERS = """u AS (SELECT a, b FROM o WHERE same AND greatest(ratio_a, ratio_b) > 0.4 UNION SELECT b, a FROM o WHERE same AND greatest(ratio_a, ratio_b) > 0.4),
h AS (SELECT read AS node, read AS seen FROM q UNION SELECT h.node, u.b FROM h JOIN u ON h.seen = u.a),
m AS (SELECT node AS read, min(seen) AS cluster FROM h GROUP BY 1)"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: what clusters share and the vote of their strands read them several times."""
    return cut(genes.clusters(_reads(spark, sf_dir), flat=genes.FLAT), "clusters")


def q_read_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each read that share over 0.9 of either's aligned bases, counted for each."""
    found = genes.overlap_ratios(_reads(spark, sf_dir), KEYS, 0.9)
    return found.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ratio_a"), 6).alias("ratio"))


Q_READ_OVERLAPS = f"WITH {ALN}, {_READS} SELECT a, count(*) AS n, round(sum(ratio_a), 6) AS ratio FROM o WHERE same AND greatest(ratio_a, ratio_b) > 0.9 GROUP BY 1"


def q_read_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes.clusters(_reads(spark, sf_dir), flat=genes.FLAT).select("read", "cluster")


Q_READ_CLUSTERS = f"WITH RECURSIVE {ALN}, {_READS}, {_CLUSTERS} SELECT read, cluster FROM m"


def q_shared_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = genes.shared_introns(_clusters(spark, sf_dir))
    return found.select("cluster", "other", F.round("ratio", 6).alias("ratio"))


_SHARED = """c AS (SELECT cluster, chrom, strand, gene, CAST(sum(fl) AS BIGINT) AS fl, count(*) AS n_reads, min(lo) AS lo, max(z) AS hi, min(q.read) AS first FROM q JOIN m USING (read) GROUP BY 1, 2, 3, 4),
j AS (SELECT DISTINCT cluster, chrom, donor, acceptor FROM q JOIN m USING (read) WHERE NOT whole),
n AS (SELECT c.*, (SELECT count(*) FROM j WHERE j.cluster = c.cluster) AS k FROM c),
f AS (SELECT x.cluster, y.cluster AS other, x.k, y.k AS o_k, (SELECT count(*) FROM j a JOIN j b USING (chrom, donor, acceptor) WHERE a.cluster = x.cluster AND b.cluster = y.cluster) AS same, coalesce(o.ratio_a, 0) AS ra, coalesce(o.ratio_b, 0) AS rb
 FROM n x JOIN n y ON x.chrom = y.chrom AND x.gene = y.gene AND x.cluster <> y.cluster AND x.lo < y.hi AND y.lo < x.hi LEFT JOIN o ON o.a = least(x.first, y.first) AND o.b = greatest(x.first, y.first)),
g AS (SELECT cluster, other, CASE WHEN k = 0 OR o_k = 0 THEN CAST(greatest(ra, rb) > 0.4 AS DOUBLE) ELSE same / k END AS ratio FROM f)"""
Q_SHARED_INTRONS = f"WITH RECURSIVE {ALN}, {_READS}, {_CLUSTERS}, {_SHARED} SELECT cluster, other, round(ratio, 6) AS ratio FROM g"


def q_strand_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes.strand_majority(_clusters(spark, sf_dir))


_MAJORITY = """v AS (SELECT x.cluster, any_value(x.fl) + coalesce(sum(y.fl), 0) AS all_, any_value(x.fl) + coalesce(sum(CASE WHEN y.strand = x.strand THEN y.fl END), 0) AS same FROM c x LEFT JOIN g ON g.cluster = x.cluster AND ratio > 0.1 LEFT JOIN c y ON y.cluster = g.other GROUP BY 1)"""
Q_STRAND_MAJORITY = f"WITH RECURSIVE {ALN}, {_READS}, {_CLUSTERS}, {_SHARED}, {_MAJORITY} SELECT cluster FROM v WHERE same >= 0.5 * all_"


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aln(spark, sf_dir).withColumn("sample", F.expr("sample % 2"))
    pair = F.explode(F.array(F.struct(F.col("rs").alias("start"), F.col("donor").alias("end")), F.struct(F.col("acceptor").alias("start"), F.col("re").alias("end"))))
    return iv.depth_runs(rows.select(*KEYS, "sample", pair.alias("b")).select(*KEYS, "sample", "b.*"), [*KEYS, "sample"])


def q_deep_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoffs = spark.range(2).select(F.col("id").alias("sample"), (F.col("id") * 2.0 + 9).alias("cutoff"))
    return genes.deep_enough(_clusters(spark, sf_dir), _depth(spark, sf_dir), cutoffs, 40)


_DEPTH = """bl AS (SELECT chrom, strand, sample % 2 AS sample, rs AS s, donor AS e FROM aln UNION ALL SELECT chrom, strand, sample % 2, acceptor, re FROM aln),
dp AS (SELECT * FROM (SELECT chrom, strand, sample, p AS s, lead(p) OVER w AS e, sum(d) OVER w AS depth FROM (SELECT chrom, strand, sample, p, sum(d) AS d FROM (SELECT chrom, strand, sample, s AS p, 1 AS d FROM bl UNION ALL SELECT chrom, strand, sample, e, -1 FROM bl) GROUP BY ALL HAVING sum(d) <> 0) WINDOW w AS (PARTITION BY chrom, strand, sample ORDER BY p)) WHERE depth > 0),
op AS (SELECT DISTINCT cluster, k.chrom, k.strand, gene, s, e FROM k JOIN m USING (read) WHERE cluster NOT IN (SELECT cluster FROM n WHERE k > 0 AND n_reads >= 40)),
ag AS (SELECT cluster, chrom, strand, gene, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN last IS NULL OR s > last THEN 1 ELSE 0 END) OVER (PARTITION BY cluster, chrom, strand, gene ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, max(e) OVER (PARTITION BY cluster, chrom, strand, gene ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM op)) GROUP BY cluster, chrom, strand, gene, i),
ba AS (SELECT cluster, sample, sum((least(ag.e, dp.e) - greatest(ag.s, dp.s)) * depth) AS bases FROM ag JOIN dp ON dp.chrom = ag.chrom AND dp.strand = ag.strand AND dp.s < ag.e AND ag.s < dp.e GROUP BY 1, 2)"""
Q_DEEP_CLUSTERS = f"""WITH RECURSIVE {ALN}, {_READS}, {_CLUSTERS}, {_SHARED}, {_DEPTH}
SELECT cluster FROM n WHERE k > 0 AND n_reads >= 40 UNION ALL SELECT DISTINCT cluster FROM ba JOIN (SELECT cluster, sum(e - s) AS size FROM ag GROUP BY 1) USING (cluster) WHERE bases / size > sample * 2.0 + 9"""


def q_cluster_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = aln(spark, sf_dir).groupBy("chrom").agg(F.max("re").alias("length"))
    return genes.gene_spans(_clusters(spark, sf_dir), sizes)


Q_CLUSTER_SPANS = f"WITH RECURSIVE {ALN}, {_READS}, {_CLUSTERS}, {_SHARED} SELECT cluster, chrom, strand, greatest(lo - 1000, 1) AS start, least(hi + 1000, length) AS \"end\" FROM c JOIN (SELECT chrom, max(re) AS length FROM aln GROUP BY 1) USING (chrom)"


def q_find_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of genes after the filters have settled (no SQL: a fixpoint of all of them)."""
    cutoffs = spark.range(2).select(F.col("id").alias("sample"), F.lit(2.0).alias("cutoff"))
    return genes.find_genes(_reads(spark, sf_dir), _depth(spark, sf_dir), cutoffs).select("read", "cluster")


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One gene for each intron with its outermost blocks, and clusters from the reads of little evidence."""
    rows = aln(spark, sf_dir).withColumn("gene", F.expr("donor div 1500"))
    block = lambda s, e: F.struct(F.col(s).alias("start"), F.col(e).alias("end"))
    found = rows.groupBy(*KEYS, "donor", "acceptor").agg(F.min("rs").alias("lo"), F.max("re").alias("hi"))
    named = found.select(F.concat_ws("_", *KEYS, "donor", "acceptor").alias("name"), *KEYS, F.array(block("lo", "donor"), block("acceptor", "hi")).alias("blocks"))
    part = rows.where("fl <= 2").select(F.concat_ws("_", F.lit("c"), *KEYS, F.expr("gene * 2 + sample % 2")).alias("cluster"), *KEYS, F.explode(F.array(block("rs", "donor"), block("acceptor", "re"))).alias("b"))
    return named, part.select("cluster", *KEYS, "b.start", "b.end")


def q_assigned_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, clusters = _members(spark, sf_dir)
    return cl.assign(named, clusters, KEYS)


_ASSIGNED = """e AS (SELECT concat_ws('_', chrom, strand, donor, acceptor) AS name, chrom, strand, donor // 1500 AS gene, min(rs) AS lo, donor, acceptor, max(re) AS hi FROM aln GROUP BY ALL),
eb AS (SELECT name, chrom, strand, gene, lo AS s, donor AS e FROM e UNION ALL SELECT name, chrom, strand, gene, acceptor, hi FROM e),
cb AS (SELECT DISTINCT concat_ws('_', 'c', chrom, strand, donor // 1500 * 2 + sample % 2) AS cluster, chrom, strand, donor // 1500 AS gene, unnest([{'s': rs, 'e': donor}, {'s': acceptor, 'e': re}]) AS b FROM aln WHERE fl <= 2),
cm AS (SELECT cluster, chrom, strand, gene, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN last IS NULL OR s > last THEN 1 ELSE 0 END) OVER (PARTITION BY cluster ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT cluster, chrom, strand, gene, b.s AS s, b.e AS e, max(b.e) OVER (PARTITION BY cluster ORDER BY b.s, b.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM cb)) GROUP BY cluster, chrom, strand, gene, k),
sh AS (SELECT name, cluster, sum(least(eb.e, cm.e) - greatest(eb.s, cm.s)) AS shared FROM eb JOIN cm ON cm.chrom = eb.chrom AND cm.strand = eb.strand AND cm.gene = eb.gene AND eb.s < cm.e AND cm.s < eb.e GROUP BY 1, 2),
asg AS (SELECT e.name, cluster FROM e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY shared DESC, cluster) AS k FROM sh) WHERE k = 1) USING (name))"""
Q_ASSIGNED_GENES = f"WITH {ALN}, {_ASSIGNED} SELECT name, cluster FROM asg"


def q_cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the members and of the spans of all clusters."""
    named, clusters = _members(spark, sf_dir)
    members = named.join(cl.assign(named, clusters, KEYS), "name").where("cluster is not null")
    members = members.select("cluster", "name", *KEYS, F.col("blocks")[0]["start"].alias("start"), F.element_at("blocks", -1)["end"].alias("end"))
    return cl.mapping_lines(members).unionByName(cl.span_lines(members))


Q_CLUSTER_LINES = f"WITH {ALN}, {_ASSIGNED}, mb AS (SELECT * FROM asg JOIN e USING (name) WHERE cluster IS NOT NULL) SELECT concat_ws(chr(9), cluster, name) AS line FROM mb UNION ALL SELECT concat_ws(chr(9), chrom, min(lo), max(hi), cluster, count(DISTINCT name), strand) FROM mb GROUP BY cluster, chrom, strand"

QUERIES = [q_assigned_genes, q_cluster_lines, q_read_overlaps, q_read_clusters, q_shared_introns, q_strand_majority, q_deep_clusters, q_cluster_spans, q_find_genes]
SQL = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES if f.__name__.upper() in globals()}
