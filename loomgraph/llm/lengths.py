"""Exact histogram of encoded lengths; suffix sums answer totals, quantiles and truncated totals for any context limit.

Defined results: null and empty texts have length 0; repeated rows each count; an empty table has no histogram rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, sliced
from loomgraph.llm._tokens import default_path, encode, forget

#: Lengths per block of the two-level sums, so that no task holds all lengths.
BLOCK = 1024


def token_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One long, `length`, per row."""
    path = path or default_path()

    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in encode(batch.column(0).to_pylist(), path)], pa.int64())], names=["length"])
        forget()

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """length and n_docs, one row per length that occurs; partly summed before the shuffle."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit:

    docs_to, tokens_to: documents of at most that length, and their tokens; docs_over, tokens_over: of the longer ones;
    truncated_tokens: tokens left if each document is cut at that length; quantile: the share of documents up to it.
    """
    block = F.floor(F.col("length") / BLOCK).alias("block")
    hist = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), block)
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a row per 1024 lengths: as many as the longest document has tokens, over 1024
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(total).alias("all_docs"), F.sum("t").over(total).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(blocks, "block").withColumn("docs_over", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_after")).withColumn(
        "tokens_over", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("t_after"))
    return out.select(
        "length", "n_docs", "n_tokens", (F.col("all_docs") - F.col("docs_over")).alias("docs_to"), (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_to"), "docs_over", "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"))


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """limits (one bigint column, `context`; few rows) with docs_to, tokens_to and truncated_tokens for each of them.
    The row that answers a limit is the one of the longest length up to it."""
    first = sums.agg(F.max(F.col("docs_to") + F.col("docs_over")).alias("n")).first()["n"] or 0
    values = sorted(r["context"] for r in limits.select(F.col("context").cast("long")).distinct().collect() if r["context"] is not None)
    best = [F.max(F.when(F.col("length") <= v, F.struct("length", "docs_to", "tokens_to"))).alias(f"at_{k}") for k, v in enumerate(values)]
    row = sums.agg(*best).first() if values else None
    made = [(v, (at := row[f"at_{k}"]) and at["docs_to"] or 0, at and at["tokens_to"] or 0) for k, v in enumerate(values)]
    return limits.sparkSession.createDataFrame([(v, d, t, t + v * (first - d)) for v, d, t in made], "context long, docs_to long, tokens_to long, truncated_tokens long")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    # the sums read the histogram twice: it is written, so the texts are encoded once
    hist = histogram(token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return suffix_sums(Scratch(spark, "lengths").keep(hist, "histogram"))
