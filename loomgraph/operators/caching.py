"""Saved repositories: the latest, their rows, what is missing and what nobody refers to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import git_sha

KEEP = 6


def recent(records: DataFrame, keep: int = KEEP) -> DataFrame:
    """repo and saved_at of the latest repositories; ties by repo. records: repo, saved_at."""
    return records.groupBy("repo").agg(F.max("saved_at").alias("saved_at")).orderBy(F.desc("saved_at"), "repo").limit(keep)


def cached(listing: DataFrame, blobs: DataFrame) -> DataFrame:
    return listing.join(blobs.select("sha"), "sha", "left_semi")


def missing(listing: DataFrame, blobs: DataFrame) -> DataFrame:
    return listing.join(blobs.select("sha"), "sha", "left_anti")


def save(files: DataFrame, folder: str, repo: str, saved_at: float) -> None:
    """Adds a repository (files: path, text) to the store in a folder: its list, and the blobs that the store doesn't hold yet.

    Lists lie in a folder per repository, which replaces the one before; blobs are named by content, so a repeated save adds none."""
    spark = files.sparkSession
    named = files.select("path", "text", git_sha(F.col("text")).alias("sha"))
    blobs = named.groupBy("sha").agg(F.first("text").alias("text"))
    try:
        blobs = missing(blobs, spark.read.schema("sha string, text string").parquet(f"{folder}/blobs"))
    except AnalysisException:  # the first save: no folder yet
        pass
    blobs.write.mode("append").parquet(f"{folder}/blobs")
    lists = named.select(F.lit(repo).alias("repo"), F.lit(float(saved_at)).alias("saved_at"), "path", "sha")
    lists.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(f"{folder}/lists")


def load(lists: DataFrame, blobs: DataFrame) -> DataFrame:
    """path and text of a saved repository: its list (path, sha) by the blobs (sha, text); paths whose blob is gone are left out."""
    return lists.join(blobs.select("sha", "text"), "sha").select("path", "text")


def load_saved(spark: SparkSession, folder: str, repo: str) -> DataFrame:
    lists = spark.read.schema("saved_at double, path string, sha string, repo string").parquet(f"{folder}/lists").where(F.col("repo") == repo)
    return load(lists, spark.read.schema("sha string, text string").parquet(f"{folder}/blobs"))


def total_bytes(listing: DataFrame) -> DataFrame:
    """bytes: the sum of all sizes; 0 for none."""
    return listing.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def unreferenced(files: DataFrame, keep: int = KEEP) -> DataFrame:
    """sha of the blobs that only repositories outside the latest refer to. files: repo, sha, saved_at."""
    kept = files.join(F.broadcast(recent(files, keep).select("repo")), "repo", "left_semi")  # at most `keep` rows
    return files.select("sha").distinct().join(kept.select("sha"), "sha", "left_anti")
