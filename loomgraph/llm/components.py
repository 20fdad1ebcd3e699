"""Distributed union-find: connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (summed before the shuffle) and a join; a vertex with very many edges is a skewed join
key, which adaptive execution splits. Every round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Large: each vertex links its larger neighbours to the least of its neighbours and itself; small: its smaller ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["w"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """id and root (the least id of its component) for every id in an edge; edges: two longs, u and v; loops don't matter."""
    now = scratch.keep(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-0")
    state = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before, k = state(now), 0
    while before["n"]:
        k += 1
        after = scratch.keep(_star(_star(now, True), False), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
        now, got = after, state(after)
        if got == before:
            break
        before = got
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
