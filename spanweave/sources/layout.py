"""Reads stored by place, so that scans of regions read the files of their places only.

A read lies once, with its chromosome and the bin of its start. Folders are stretches of neighbouring bins, ``FOLDERS`` of them
at most for a chromosome, so that a long genome or small bins don't make folders and files without end. Beside the reads stands an index with
the furthest end of each bin's reads, a row for each bin of the genome that has any. Regions find their bins in the index (an
end behind the region's start is enough, so a read over a bin's edge is found from its own bin, once) and meet the
reads by chromosome, folder and bin; Spark prunes the other folders at run time.

Files are cut by a range shuffle over place, so that a deep bin is many files and thin ones share a task. Reads without a place
are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import intervals as iv

BIN = 1 << 20
#: Most folders of a chromosome.
FOLDERS = 64


def write_reads(reads: DataFrame, path: str, size: int = BIN) -> None:
    """Stores reads (chrom, rs, re and any other columns) with their index under a path."""
    placed = reads.where("chrom is not null and rs is not null and re is not null")
    low, high = placed.agg(F.min(F.floor(F.col("rs") / size)), F.max(F.floor(F.col("rs") / size))).first()
    width = 1 if low is None else (high - low) // FOLDERS + 1
    placed = placed.withColumn("__place", F.floor(F.col("rs") / size)).withColumn("bin", F.floor(F.col("__place") / width))
    placed.repartitionByRange("chrom", "__place", "rs", "re").sortWithinPartitions("chrom", "__place", "rs").write.mode("overwrite").partitionBy("chrom", "bin").parquet(f"{path}/reads")
    stored = _reads(reads.sparkSession, path)
    index = stored.groupBy("chrom", "bin", "__place").agg(F.max("re").alias("furthest"), F.count(F.lit(1)).alias("n")).withColumn("size", F.lit(size))
    index.write.mode("overwrite").parquet(f"{path}/index")  # a row for each bin of the genome


def _reads(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"chrom": StringType(), "bin": LongType()}  # whatever the folders' names look like
    given = spark.read.parquet(f"{path}/reads").schema
    return spark.read.schema(StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in given])).parquet(f"{path}/reads")


def stored_reads(spark: SparkSession, path: str) -> DataFrame:
    """All reads as they were given."""
    return _reads(spark, path).drop("bin", "__place")


def scan_stored(regions: DataFrame, path: str) -> DataFrame:
    """The reads that share a base with each region (chrom, start, end and other columns, not named as the reads'): the region's
    columns, start and end as r_start and r_end, and the reads'."""
    spark = regions.sparkSession
    named = regions.withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end").where("r_start < r_end")
    index = spark.read.parquet(f"{path}/index")
    size = index.select("size").first()
    spans = index.select("chrom", "bin", "__place", (F.col("__place") * F.col("size")).alias("__from"), F.col("furthest").alias("__to"))
    places = iv.overlap_join(named, spans, ["chrom"], size[0] if size else BIN, ("r_start", "r_end"), ("__from", "__to")).drop("__from", "__to")
    folders = F.broadcast(places.select("chrom", "bin").distinct())  # a row for each folder at most
    met = _reads(spark, path).join(folders, ["chrom", "bin"], "left_semi").drop("bin").join(places.drop("bin"), ["chrom", "__place"])
    return met.where("rs < r_end and r_start < re").drop("__place")
