"""Tables that cut lineage: written where all executors can read them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    A single-machine session without the setting gets a temporary folder; on a cluster there is
    no such thing as a safe default, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "spanweave-shared")
    return named.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path of its own in the application's folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: short lineage that outlives executors.

    All tables of an application lie in one folder named by its id, to be removed with it."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
