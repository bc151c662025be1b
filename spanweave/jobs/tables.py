"""The given tables, and read-like rows that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spliced read for each order line: two blocks around one gap."""
    d = F.expr("(l_partkey div 20) * 1500 + 200 + 100 * (cast(l_quantity as bigint) % 3)")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", d.alias("donor"))
    acceptor = F.col("donor") + 100 * (1 + F.col("l_suppkey") % 4)
    return rows.select(
        F.concat(F.lit("Chr"), "l_returnflag").alias("chrom"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        (F.col("donor") - 20 - F.col("l_orderkey") % 80).alias("rs"),
        "donor",
        acceptor.alias("acceptor"),
        (acceptor + 20 + F.col("l_linenumber") * 10).alias("re"),
        F.col("l_suppkey").alias("sample"),
        F.col("l_linenumber").cast("long").alias("fl"),
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("name"),
        (F.col("l_orderkey") % 512).cast("int").alias("flag"),
    )


#: The same rows in the other dialect; the queries' SQL begins with it.
ALN = """aln AS (SELECT 'Chr' || l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
 d - 20 - l_orderkey % 80 AS rs, d AS donor, d + 100*(1 + l_suppkey % 4) AS acceptor, d + 100*(1 + l_suppkey % 4) + 20 + l_linenumber*10 AS re,
 l_suppkey AS sample, CAST(l_linenumber AS BIGINT) AS fl, 'r' || CAST(l_orderkey AS VARCHAR) AS name, CAST(l_orderkey % 512 AS INTEGER) AS flag
 FROM (SELECT *, (l_partkey // 20)*1500 + 200 + 100*(CAST(floor(l_quantity) AS BIGINT) % 3) AS d FROM lineitem))"""
