"""Streams: incremental article ingest, deduplicated events, windows with late data, sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.articles import upsert


def source(spark: SparkSession, path: str, schema: str | None = None, files: int = 4) -> DataFrame:
    """A stream of the parquet files of a folder, or of one file (a stream reads folders: its own, by name)."""
    kind = spark.read.parquet(path).schema if schema is None else schema
    r = spark.readStream.schema(kind).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return r.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return r.parquet(path)


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; state of keys goes once the watermark has passed them."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, ts: str, width: str = "1 hour", late: str = "1 day", by: str = "event_type") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = e.groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str = "6 hours", late: str = "1 day", by: str = "user_id") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    s = e.groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and reads what it wrote. folder: where all executors can write."""
    spark, name = stream.sparkSession, uuid.uuid4().hex[:12]
    out = f"{folder}/stream-{name}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number:08d}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def history_sink(folder: str, scraped: str):
    """For foreachBatch: upserts each batch into a history under `folder`; a batch seen twice changes nothing.

    Versions are written beside each other; a version counts once its _SUCCESS is there.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = latest(spark, folder)
        new = upsert(batch.limit(0) if old is None else old, batch, scraped)
        new.write.mode("overwrite").parquet(f"{folder}/version={number:012d}")

    return put


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest whole version of a history."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = sorted(s.getPath().toString() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(found[-1]) if found else None
