"""Genes of other sources put to clusters of genes, and what is written of a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals as iv


def listed_genes(listed: DataFrame, genes: DataFrame) -> DataFrame:
    """cluster and the columns of genes (name, ...) for each listed (cluster, gene); a listed gene that is not
    among genes is an error when the table is computed."""
    met = listed.join(genes, listed["gene"] == genes["name"], "left")
    checked = F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("no such gene: "), F.coalesce("gene", F.lit("null"))))).otherwise(F.col("name"))
    return met.withColumn("name", checked.cast("string")).drop("gene")


def assign(genes: DataFrame, clusters: DataFrame, by: list[str], bin_size: int = 1000) -> DataFrame:
    """name and cluster: each gene with the cluster that shares most of its exons' bases on its strand, the first of
    equals; null where none shares any. genes: name, by, blocks; clusters: cluster, by, start, end (exon blocks)."""
    parts = genes.select("name", *by, F.explode("blocks").alias("b")).select("name", *by, F.col("b.start").alias("s"), F.col("b.end").alias("e"))
    solid = iv.merge_intervals(clusters, ["cluster", *by]).select("cluster", *by, "start", "end")
    shared = iv.overlap_join(parts, solid, by, bin_size, ("s", "e"), ("start", "end")).groupBy("name", "cluster").agg(F.sum(iv.shared_bases(("s", "e"), ("start", "end"))).alias("shared"))
    best = shared.groupBy("name").agg(F.min_by("cluster", F.struct(-F.col("shared"), F.col("cluster"))).alias("cluster"))
    return genes.select("name").distinct().join(best, "name", "left")


def mapping_lines(members: DataFrame) -> DataFrame:
    """line: cluster and gene, parted by a tab."""
    return members.select(F.concat_ws("\t", "cluster", "name").alias("line"))


def span_lines(members: DataFrame) -> DataFrame:
    """line: BED6 of each cluster's span, its number of genes as score. members: cluster, name, chrom, strand, start, end.
    A cluster with genes of several chromosomes or strands is an error when the table is computed."""
    place = F.struct("chrom", "strand")
    rows = members.groupBy("cluster").agg(F.min(place).alias("place"), F.max(place).alias("other"), F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct("name").alias("n"))
    split = F.raise_error(F.concat(F.lit("on several chromosomes or strands: "), F.col("cluster").cast("string"))).cast("string")
    rows = rows.withColumn("chrom", F.when(F.col("place").eqNullSafe(F.col("other")), F.col("place.chrom")).otherwise(split)).withColumn("strand", F.col("place.strand"))
    return rows.select(F.concat_ws("\t", "chrom", "start", "end", "cluster", F.col("n").cast("string"), "strand").alias("line"))
