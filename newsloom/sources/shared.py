"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that has none gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='newsloom-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def dealt(df: DataFrame) -> DataFrame:
    """df for a join that deals out both sides. Spark plans with the size of compressed files and takes exploded rows for
    one of what they come from, so that it would send tables to the driver, and to each executor, that fit neither."""
    return df.hint("merge")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table there: its lineage ends, later readers prune its columns, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/newsloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
