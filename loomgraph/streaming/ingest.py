"""Incremental ingest: files whose content was never seen before, from a stream of file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions.text import git_sha


def new_blobs(stream: DataFrame, seen_for: str = "7 days") -> DataFrame:
    """path, sha, text and arrived of rows (path, text, arrived) whose content did not arrive before within `seen_for`; state is bounded by it."""
    return stream.withColumn("sha", git_sha(F.col("text"))).withWatermark("arrived", seen_for).dropDuplicatesWithinWatermark(["sha"])


def blobs(spark: SparkSession, store: str) -> DataFrame:
    """sha, text and batch of all stored contents."""
    return spark.read.schema("sha string, text string, batch long").parquet(store)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_new(batch: DataFrame, number: int, store: str) -> None:
    """Adds the contents of a batch (path, text) that no other batch has stored, each once. A batch's part of the store is replaced as a whole, and is not
    looked at when it comes again, so a repeated batch leaves the store as it was. Null texts have no content."""
    spark = batch.sparkSession
    rows = batch.where("text is not null").select(git_sha(F.col("text")).alias("sha"), "text")
    fresh = rows.groupBy("sha").agg(F.first("text").alias("text"))  # equal texts
    if _exists(spark, store):
        fresh = fresh.join(blobs(spark, store).where(F.col("batch") != number).select("sha"), "sha", "left_anti")
    fresh.write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/batch={number}")


def ingest(stream: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stores each content of a stream of rows (path, text) once and for good, however much later it comes again."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: append_new(batch, number, store)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
