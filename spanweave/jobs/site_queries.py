"""Queries on sites that reads themselves show: density clusters of their ends, and the sites inferred from them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import elements as el
from ..operators import intervals as iv
from ..operators import sites
from .scan_queries import _R, _VOTES, GENE, _reads
from .tables import ALN

#: Thinner data than reads of a genome: a lower rise and a shorter reach.
THIN = replace(DEFAULT, density_rise=1.5, site_distance=60)
KINDS = ("start", "stop")


def q_site_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the reads' ends of each gene, both kinds."""
    rows = _reads(spark, sf_dir)
    return iv.union_all([sites.density_clusters(el.site_votes(rows, GENE, k), GENE, THIN).withColumn("kind", F.lit(k)) for k in KINDS])


_KEY = "chrom, strand, gene, kind"
_SPLIT = f"""SELECT {_KEY}, b, e, low, n, p0, p1, total, least(p, s) AS high, CASE WHEN p < s THEN pi ELSE si END AS mid FROM (
  SELECT {_KEY}, b, e, low, count(*) AS n, min(p0) AS p0, max(p1) AS p1, sum(votes) AS total,
   coalesce(min(CASE WHEN i > b THEN (c - votes - c0) / (pos - p0) END), 'inf') AS p, coalesce(min(CASE WHEN i > b THEN (c1 - c + votes) / (p1 - before) END), 'inf') AS s,
   min(CASE WHEN i > b THEN row((c - votes - c0) / (pos - p0), i) END)[2] AS pi, -min(CASE WHEN i > b THEN row((c1 - c + votes) / (p1 - before), -i) END)[2] AS si
  FROM (SELECT *, min(pos) OVER g AS p0, max(pos) OVER g AS p1, min(c - votes) OVER g AS c0, max(c) OVER g AS c1 FROM seg JOIN h USING ({_KEY}) WHERE i BETWEEN b AND e WINDOW g AS (PARTITION BY {_KEY}, b, e))
  GROUP BY {_KEY}, b, e, low) WHERE total >= {THIN.cluster_reads}"""
_CLUSTERS = f"""h AS (SELECT {_KEY}, pos, CAST(votes AS DOUBLE) AS votes, row_number() OVER g AS i, CAST(sum(votes) OVER g AS DOUBLE) AS c, lag(pos) OVER g AS before FROM v WINDOW g AS (PARTITION BY {_KEY} ORDER BY pos)),
seg AS (SELECT {_KEY}, CAST(1 AS BIGINT) AS b, max(i) AS e, 0::DOUBLE AS low FROM h GROUP BY ALL
  UNION ALL SELECT {_KEY}, unnest([b, mid]), unnest([mid - 1, e]), greatest(low, high) FROM ({_SPLIT}) WHERE high < 'inf'),
fit AS (SELECT {_KEY}, p0, p1, n, total FROM ({_SPLIT}) WHERE high > low AND n > 1 AND p1 - p0 < {THIN.cluster_length} AND high >= {THIN.density_rise} * low),
cl AS (SELECT * FROM fit WHERE NOT EXISTS (SELECT 1 FROM fit o WHERE (o.chrom, o.strand, o.gene, o.kind) = (fit.chrom, fit.strand, fit.gene, fit.kind) AND o.p0 <= fit.p0 AND o.p1 >= fit.p1 AND (o.p0, o.p1) <> (fit.p0, fit.p1)))"""
_BASE = f"WITH RECURSIVE {ALN}, {_R}, {_VOTES}, {_CLUSTERS}"
Q_SITE_CLUSTERS = f'{_BASE} SELECT {_KEY}, CAST(p0 AS BIGINT) AS start, CAST(p1 AS BIGINT) AS "end", n AS n_sites, total AS votes FROM cl'


def q_inferred_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sites (those of an evidence over 25) and, away from them, those that clusters show."""
    rows, out = _reads(spark, sf_dir), []
    for kind in KINDS:
        known = el.site_votes(rows, GENE, kind).where("votes > 25")
        out.append(sites.with_inferred(known, rows, GENE, kind, THIN).withColumn("kind", F.lit(kind)))
    return iv.union_all(out)


Q_INFERRED_SITES = f"""{_BASE}, m AS (SELECT {_KEY}, (p0 + p1) // 2 AS pos, n FROM cl),
top AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE (o.chrom, o.strand, o.gene, o.kind) = (m.chrom, m.strand, m.gene, m.kind) AND abs(o.pos - m.pos) <= {THIN.site_distance} AND (o.n > m.n OR (o.n = m.n AND o.pos < m.pos)))),
k AS (SELECT {_KEY}, pos FROM v WHERE votes > 25)
SELECT {_KEY}, pos FROM k UNION ALL SELECT {_KEY}, pos FROM top WHERE NOT EXISTS (SELECT 1 FROM k WHERE (k.chrom, k.strand, k.gene, k.kind) = (top.chrom, top.strand, top.gene, top.kind) AND abs(k.pos - top.pos) < {THIN.site_distance})"""

QUERIES = [q_site_clusters, q_inferred_sites]
SQL = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
