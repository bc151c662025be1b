"""Queries on segments, projected reads, links between segments, and assembled isoforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import elements as el
from ..operators import intervals as iv
from ..operators import paths
from ..operators import segments as sg
from ..storage import cut
from .scan_queries import _INNER, _INTRONS, _R, _VOTES, GENE, Q_FIRST_EXONS, Q_LAST_EXONS, _introns, _reads, _sites
from .tables import ALN


def _elements(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    introns, starts, stops = cut(_introns(spark, sf_dir), "introns"), cut(_sites(spark, sf_dir, "start"), "sites"), cut(_sites(spark, sf_dir, "stop"), "sites")
    exons = {"first": el.first_exons(starts, stops, introns, GENE), "last": el.last_exons(starts, stops, introns, GENE), "inner": el.inner_exons(introns, GENE)}
    return {"introns": introns, **{k: cut(df, f"{k}-exons") for k, df in exons.items()}}


def _segments(spark: SparkSession, sf_dir: str, found: dict[str, DataFrame] | None = None) -> DataFrame:
    """Written once: queries join the segments several times, each of them with elements of all reads behind it."""
    return cut(sg.tagged(by=GENE, **(found or _elements(spark, sf_dir))), "segments")


def q_tagged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


_SEGMENTS = f"""fx AS (SELECT * FROM ({Q_FIRST_EXONS})), lx AS (SELECT * FROM ({Q_LAST_EXONS})),
bd AS (SELECT DISTINCT chrom, strand, gene, unnest([s, e]) AS p FROM (SELECT chrom, strand, gene, start AS s, stop AS e FROM i UNION ALL SELECT chrom, strand, gene, start, "end" FROM fx UNION ALL SELECT chrom, strand, gene, start, "end" FROM lx UNION ALL SELECT chrom, strand, gene, start, stop FROM x)),
sg0 AS (SELECT * FROM (SELECT chrom, strand, gene, row_number() OVER w - 1 AS seg_idx, p AS start, lead(p) OVER w AS stop FROM bd WINDOW w AS (PARTITION BY chrom, strand, gene ORDER BY p)) WHERE stop IS NOT NULL),
sg AS (SELECT chrom, strand, gene, seg_idx, start, stop,
 CASE WHEN strand = '-' THEN (chrom, strand, gene, stop) IN (SELECT (chrom, strand, gene, "end") FROM fx) ELSE (chrom, strand, gene, start) IN (SELECT (chrom, strand, gene, start) FROM fx) END AS is_start,
 CASE WHEN strand = '-' THEN (chrom, strand, gene, start) IN (SELECT (chrom, strand, gene, start) FROM lx) ELSE (chrom, strand, gene, stop) IN (SELECT (chrom, strand, gene, "end") FROM lx) END AS is_stop,
 (chrom, strand, gene, start) IN (SELECT (chrom, strand, gene, start) FROM i WHERE spliced) OR (chrom, strand, gene, stop) IN (SELECT (chrom, strand, gene, stop) FROM i WHERE spliced) AS is_spliced FROM sg0)"""
_BASE = f"WITH {ALN}, {_R}, {_VOTES}, {_INTRONS}, {_INNER}, {_SEGMENTS}"
Q_TAGGED_SEGMENTS = f"{_BASE} SELECT chrom, strand, gene, seg_idx, start, stop AS \"end\", is_start, is_stop, is_spliced FROM sg"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda s, e: F.struct(F.col(s).alias("start"), F.col(e).alias("end"))
    return _reads(spark, sf_dir).withColumn("blocks", F.array(pair("rs", "donor"), pair("acceptor", "re")))


def q_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads on the segments of their gene, and which borders of segments they cover."""
    return sg.project(_shapes(spark, sf_dir), _segments(spark, sf_dir), GENE, text=True)


Q_PROJECTION = f"""{_BASE}, sh AS (SELECT chrom, strand, gene, rs, donor, acceptor, re, CAST(sum(fl) AS BIGINT) AS fl FROM r GROUP BY ALL),
pj AS (SELECT sh.*, seg_idx, (greatest(least(donor, stop) - greatest(rs, start), 0) + greatest(least(re, stop) - greatest(acceptor, start), 0)) * 2 >= stop - start AS p,
 (rs <= start AND start < donor) OR (acceptor <= start AND start < re) AS a, (rs <= stop - 1 AND stop - 1 < donor) OR (acceptor <= stop - 1 AND stop - 1 < re) AS b FROM sh JOIN sg USING (chrom, strand, gene)),
al AS (SELECT chrom, strand, gene, fl, string_agg(CASE WHEN p THEN '1' ELSE '0' END, '' ORDER BY seg_idx) AS path, string_agg(CASE WHEN a THEN '1' ELSE '0' END, '' ORDER BY seg_idx) AS covers_first, string_agg(CASE WHEN b THEN '1' ELSE '0' END, '' ORDER BY seg_idx) AS covers_last FROM pj GROUP BY chrom, strand, gene, rs, donor, acceptor, re, fl)
SELECT chrom, strand, gene, path, covers_first, covers_last, CAST(sum(fl) AS BIGINT) AS fl FROM al WHERE contains(path, '1') GROUP BY ALL"""


def q_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads inside a gene's segments across its introns, and through its borders, by sample."""
    links, borders = sg.link_counts(_shapes(spark, sf_dir), _segments(spark, sf_dir), GENE)
    return links.withColumn("kind", F.lit("across")).unionByName(borders.select(*GENE, "sample", "first", (F.col("first") + 1).alias("last"), "n", F.lit("through").alias("kind")))


_LINKS = """sp AS (SELECT chrom, strand, gene, min(start) AS lo, max(stop) AS hi FROM sg GROUP BY ALL),
rd AS (SELECT r.* FROM r JOIN sp USING (chrom, strand, gene) WHERE rs >= lo AND re <= hi),
lk AS (SELECT rd.chrom, rd.strand, rd.gene, sample, f.seg_idx AS first, l.seg_idx AS last, count(*) AS n FROM rd JOIN sg f ON (f.chrom, f.strand, f.gene, f.start) = (rd.chrom, rd.strand, rd.gene, donor) JOIN sg l ON (l.chrom, l.strand, l.gene, l.stop) = (rd.chrom, rd.strand, rd.gene, acceptor) GROUP BY ALL),
br AS (SELECT rd.chrom, rd.strand, rd.gene, sample, seg_idx - 1 AS first, count(*) AS n FROM rd JOIN sg ON (sg.chrom, sg.strand, sg.gene) = (rd.chrom, rd.strand, rd.gene) AND ((rs < start AND start < donor) OR (acceptor < start AND start < re)) GROUP BY ALL)"""
Q_LINK_COUNTS = f"{_BASE}, {_LINKS} SELECT chrom, strand, gene, sample, first, last, n, 'across' AS kind FROM lk UNION ALL SELECT chrom, strand, gene, sample, first, first + 1, n, 'through' FROM br"


def _indexed(spark: SparkSession, sf_dir: str, segments: DataFrame) -> DataFrame:
    found = iv.segment_index(_introns(spark, sf_dir), segments, GENE)
    return found.select(*GENE, F.col("first_seg").alias("first"), F.col("last_seg").alias("last"), "spliced")


def q_intron_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns by the vote of the samples; what a spliced segment decides is out."""
    segments = _segments(spark, sf_dir)
    links, borders = sg.link_counts(_shapes(spark, sf_dir), segments, GENE)
    samples = _reads(spark, sf_dir).select("sample").distinct()
    return sg.intron_kinds(_indexed(spark, sf_dir, segments), links, borders, segments, GENE, samples)


Q_INTRON_KINDS = f"""{_BASE}, {_LINKS}, ix AS (SELECT i.chrom, i.strand, i.gene, f.seg_idx AS first, l.seg_idx AS last FROM i JOIN sg f ON (f.chrom, f.strand, f.gene, f.start) = (i.chrom, i.strand, i.gene, i.start) JOIN sg l ON (l.chrom, l.strand, l.gene, l.stop) = (i.chrom, i.strand, i.gene, i.stop)),
ph AS (SELECT ix.*, sm.sample, (coalesce(lk.n, 0) + 0.5::DOUBLE) / (coalesce(lk.n, 0) + (coalesce(a.n, 0) + coalesce(b.n, 0)) / 2 + 1) AS phi FROM ix CROSS JOIN (SELECT DISTINCT sample FROM r) sm
 LEFT JOIN lk ON (lk.chrom, lk.strand, lk.gene, lk.sample, lk.first, lk.last) = (ix.chrom, ix.strand, ix.gene, sm.sample, ix.first, ix.last)
 LEFT JOIN br a ON (a.chrom, a.strand, a.gene, a.sample, a.first + 1) = (ix.chrom, ix.strand, ix.gene, sm.sample, ix.first)
 LEFT JOIN br b ON (b.chrom, b.strand, b.gene, b.sample, b.first) = (ix.chrom, ix.strand, ix.gene, sm.sample, ix.last)),
vt AS (SELECT chrom, strand, gene, first, last, count(*) FILTER (WHERE phi > 0.7) AS o, count(*) FILTER (WHERE phi < 0.3) AS k, count(*) FILTER (WHERE phi BETWEEN 0.3 AND 0.7) AS b FROM ph GROUP BY ALL)
SELECT chrom, strand, gene, first, last, CASE WHEN o >= greatest(k, b) THEN 'out' WHEN k >= b THEN 'kept' WHEN EXISTS (SELECT 1 FROM sg WHERE sg.chrom = vt.chrom AND sg.strand = vt.strand AND sg.gene = vt.gene AND is_spliced AND seg_idx BETWEEN first AND last) THEN 'out' ELSE 'both' END AS kind FROM vt"""


def q_path_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each gene: pairs of projected paths that overlap, agree where both span, and of which one spans the other."""
    ends = paths.tag(sg.project(_shapes(spark, sf_dir), _segments(spark, sf_dir), GENE).select(*GENE, F.col("path").alias("segary")).distinct())
    one = lambda x: ends.select(*GENE, *(F.col(c).alias(x + c) for c in ("segary", "sidx", "eidx")))
    low, high = F.greatest("a_sidx", "b_sidx"), F.least("a_eidx", "b_eidx")
    stretch = lambda c: F.slice(c, low + 1, F.greatest(high - low + 1, F.lit(0)))
    met = one("a_").join(one("b_"), GENE).where("a_segary <> b_segary").withColumn("overlap", low <= high)
    met = met.withColumn("agree", ~F.col("overlap") | (stretch("a_segary") == stretch("b_segary")))
    spans = F.col("agree") & (F.col("a_sidx") <= F.col("b_sidx")) & (F.col("b_eidx") <= F.col("a_eidx"))
    count = lambda c, name: F.sum(c.cast("int")).alias(name)
    return met.groupBy(*GENE).agg(count(F.col("overlap"), "n_overlap"), count(F.col("agree"), "n_agree"), count(spans, "n_spans"))


Q_PATH_PAIRS = f"""WITH pt AS (SELECT DISTINCT chrom, strand, gene, path, strpos(path, '1') AS s, length(path) - strpos(reverse(path), '1') + 1 AS e FROM ({Q_PROJECTION})),
pr AS (SELECT a.chrom, a.strand, a.gene, greatest(a.s, b.s) <= least(a.e, b.e) AS o, greatest(a.s, b.s) > least(a.e, b.e) OR substr(a.path, greatest(a.s, b.s), least(a.e, b.e) - greatest(a.s, b.s) + 1) = substr(b.path, greatest(a.s, b.s), least(a.e, b.e) - greatest(a.s, b.s) + 1) AS g, a.s <= b.s AND b.e <= a.e AS c FROM pt a JOIN pt b USING (chrom, strand, gene) WHERE a.path <> b.path)
SELECT chrom, strand, gene, CAST(sum(CAST(o AS INTEGER)) AS BIGINT) AS n_overlap, CAST(sum(CAST(g AS INTEGER)) AS BIGINT) AS n_agree, CAST(sum(CAST(g AND c AS INTEGER)) AS BIGINT) AS n_spans FROM pr GROUP BY ALL"""


def assembly_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What paths.assemble takes, from all reads; and the segments."""
    found = _elements(spark, sf_dir)
    segments = _segments(spark, sf_dir, found)
    size = segments.groupBy(*GENE).agg(F.count(F.lit(1)).cast("int").alias("n_segs"))
    reads = sg.project(_shapes(spark, sf_dir), segments, GENE, text=True).withColumn("kind", F.lit("read"))
    index = lambda df, kind: iv.segment_index(df.select(*GENE, "start", "end").distinct(), segments, GENE).select(*GENE, F.lit(kind).alias("kind"), F.col("first_seg").alias("first"), F.col("last_seg").alias("last"))
    parts = [reads, index(found["introns"], "intron"), *(index(found[k], "exon") for k in ("first", "last", "inner"))]
    parts += [segments.where(f"is_{k}").select(*GENE, F.lit(k).alias("kind"), F.col("seg_idx").alias("first"), F.col("seg_idx").alias("last")) for k in ("start", "stop", "spliced")]
    parts.append(index(found["introns"].where("spliced"), "lone").where("first = last"))
    links, borders = sg.link_counts(_shapes(spark, sf_dir), segments, GENE)
    parts += [links.withColumn("kind", F.lit("link")), borders.withColumn("kind", F.lit("border"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.join(size, GENE), segments


def q_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over all genes (no SQL: cliques and completion)."""
    found = paths.assemble(assembly_rows(spark, sf_dir)[0], GENE)
    return found.select(*GENE, F.array_join("path", "").alias("path"), "label", "fl", "cluster")


def q_isoform_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED12 lines of all isoforms, by kind."""
    rows, segments = assembly_rows(spark, sf_dir)
    found = paths.assemble(rows, GENE).withColumn("name", F.concat(F.lit("c_"), F.col("gene").cast("string")))
    return paths.isoform_lines(found, segments, GENE, "name", ["path"])


def _segment_depth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Depth of each strand by sample, and the samples: reads of 150 bases."""
    rows = _reads(spark, sf_dir)
    pair = F.explode(F.array(F.struct(F.col("rs").alias("start"), F.col("donor").alias("end")), F.struct(F.col("acceptor").alias("start"), F.col("re").alias("end"))))
    depth = iv.depth_runs(rows.select("chrom", "strand", "sample", pair.alias("b")).select("chrom", "strand", "sample", "b.*"), ["chrom", "strand", "sample"])
    return depth, rows.groupBy("sample").agg(F.count(F.lit(1)).alias("mapped"), F.lit(150).alias("length"))


def q_segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth over each segment, in reads of each sample."""
    depth, samples = _segment_depth(spark, sf_dir)
    found = sg.segment_counts(_segments(spark, sf_dir), depth, samples, GENE, ["chrom", "strand"])
    return found.withColumn("count", F.round("count", 5))


Q_SEGMENT_COUNTS = f"""{_BASE}, bl AS (SELECT chrom, strand, sample, rs AS s, donor AS e FROM r UNION ALL SELECT chrom, strand, sample, acceptor, re FROM r),
sh AS (SELECT sg.chrom, sg.strand, sg.gene, seg_idx, sample, sum(least(e, stop) - greatest(s, start)) AS bases FROM sg JOIN bl ON bl.chrom = sg.chrom AND bl.strand = sg.strand AND s < stop AND start < e GROUP BY ALL)
SELECT sg.chrom, sg.strand, sg.gene, sg.seg_idx, sm.sample, stop - start AS length, round(coalesce(bases, 0) / 150 + 1e-6::DOUBLE, 5) AS count FROM sg CROSS JOIN (SELECT DISTINCT sample FROM r) sm LEFT JOIN sh USING (chrom, strand, gene, seg_idx, sample)"""


def q_segment_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the expression of each segment in each sample (no SQL: beta quantiles)."""
    depth, samples = _segment_depth(spark, sf_dir)
    return sg.segment_expression(_segments(spark, sf_dir), depth, samples, GENE, ["chrom", "strand"])


def q_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isoforms of each label (no SQL: the cascade)."""
    return paths.label_counts(paths.assemble(assembly_rows(spark, sf_dir)[0], GENE), GENE)


QUERIES = [q_segment_counts, q_segment_expression, q_label_counts, q_tagged_segments, q_projection, q_link_counts, q_intron_kinds, q_path_pairs, q_assemble, q_isoform_lines]
SQL = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES if f.__name__.upper() in globals()}
