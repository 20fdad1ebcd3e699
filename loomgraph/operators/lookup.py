"""Search, details, counts and lines-to-symbols lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip, subsequence
from loomgraph.operators._store import cut
from loomgraph.operators.views import CONTAIN, REF


def search(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """key, cls (0 exact, 1 prefix, 2 inside, 3 in a file's path, 4 subsequence) and rank of the best hits; ties by key."""
    q, name = query.strip().lower(), F.lower("name")
    cls = F.when(name == q, 0).when(name.startswith(q), 1).when(name.contains(q), 2).when((F.col("kind") == "file") & F.lower("path").contains(q), 3)
    if len(q) > 1:
        cls = cls.when(subsequence(q, name), 4)
    best = nodes.select("key", cls.alias("cls"), F.length("name").alias("n")).where("cls is not null").orderBy("cls", "n", "key").limit(limit)
    return best.select("key", "cls", F.row_number().over(Window.orderBy("cls", "n", "key")).alias("rank"))


def details(nodes: DataFrame, edges: DataFrame, key: str, most: int = 150) -> DataFrame:
    """section (children, keywords, uses, used_by), key, weak and rn of a node's lists, with total; at most `most` rows of each.
    Links that only match by name are weak and come last; folders come before files."""
    info = nodes.select(F.col("key").alias("other"), "kind", "name")
    out = edges.where(F.col("s") == key).select(F.col("t").alias("other"), "type", F.lit("out").alias("way"))
    into = edges.where((F.col("t") == key) & (F.col("type") != CONTAIN)).select(F.col("s").alias("other"), "type", F.lit("in").alias("way"))
    rows = out.unionByName(into).join(info, "other")
    section = F.when(F.col("way") == "in", "used_by").when(F.col("type") == CONTAIN, "children").when(F.col("kind") == "keyword", "keywords").otherwise("uses")
    first = F.when(section == "children", F.when(F.col("kind") == "dir", 0).otherwise(1)).otherwise(F.when(F.col("type") == REF, 1).otherwise(0))
    rows = cut(rows.select(section.alias("section"), F.col("other").alias("key"), (F.col("type") == REF).alias("weak"), first.alias("first"), "name"))  # once for the lists and their lengths
    rn = F.row_number().over(Window.partitionBy("section").orderBy("first", "name", "key"))  # alone in its window, so its limit reaches the tasks that read
    total = rows.groupBy("section").agg(F.count("*").alias("total"))
    return rows.withColumn("rn", rn).where(F.col("rn") <= most).join(F.broadcast(total), "section").select("section", "key", "weak", "rn", "total")  # four sections at most


def peek_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """key and n: in-edges of libraries and keywords, out-edges of folders, definitions of files."""
    ins = edges.groupBy(F.col("t").alias("key")).agg(F.count("*").alias("n_in"))
    outs = edges.groupBy(F.col("s").alias("key")).agg(F.count("*").alias("n_out"), F.count(F.when(F.col("type") == CONTAIN, 1)).alias("n_defs"))
    some = nodes.where(F.col("kind").isin("lib", "keyword", "dir", "file")).select("key", "kind")
    n = F.when(F.col("kind").isin("lib", "keyword"), F.col("n_in")).when(F.col("kind") == "dir", F.col("n_out")).otherwise(F.col("n_defs"))
    return some.join(ins, "key", "left").join(outs, "key", "left").select("key", F.coalesce(n, F.lit(0)).alias("n"))


def first_lines(symbols: DataFrame, files: DataFrame, most: int = 160) -> DataFrame:
    """key and code: the trimmed line on which each symbol (key, path, line from 0) begins; empty without file or line."""
    line = strip(F.coalesce(F.get(F.split("text", "\n"), F.col("line")), F.lit("")))
    return symbols.join(files.select("path", "text"), "path", "left").select("key", F.substr(line, F.lit(1), F.lit(most)).alias("code"))


def line_click(symbols: DataFrame, clicks: DataFrame, grain: int = 64) -> DataFrame:
    """click_id and key: the shortest symbol (key, file_key, line, end) that covers a clicked line (click_id, file_key, line), the outer
    one (it begins first, then has the least key) of equally long ones; the file itself where none does."""
    bucket = lambda c: F.floor(F.col(c) / grain).cast("long")
    spans = symbols.select("key", "file_key", F.col("line").alias("lo"), F.col("end").alias("hi"))
    met = clicks.withColumn("bucket", bucket("line")).join(spans.withColumn("bucket", F.explode(F.sequence(bucket("lo"), bucket("hi")))), ["file_key", "bucket"]).where("line between lo and hi")
    best = met.groupBy("click_id").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("size"), "lo", "key")).alias("m"))
    return clicks.join(best, "click_id", "left").select("click_id", F.coalesce("m.key", "file_key").alias("key"))


def without_kin(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links (s, t, type) without those of a node to itself, to its parent or to its child."""
    up = nodes.select("key", F.col("parent_key").alias("_up"))
    met = links.where("s <> t").join(up.select(F.col("key").alias("s"), F.col("_up").alias("_s_up")), "s", "left").join(up.select(F.col("key").alias("t"), F.col("_up").alias("_t_up")), "t", "left")
    return met.where("not (_s_up <=> t) and not (_t_up <=> s)").select("s", "t", "type")


def by_key(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The nodes that have the asked keys (column key)."""
    return nodes.join(keys.select("key").distinct(), "key", "left_semi")


def map_into(nodes: DataFrame, shown: DataFrame) -> DataFrame:
    """key and view_key: the node itself where the view shows it, else its file where that is shown, else null."""
    keys = shown.select("key")
    own = keys.withColumn("own", F.col("key"))
    file = keys.select(F.col("key").alias("file_key"), F.col("key").alias("of_file"))
    return nodes.select("key", "file_key").join(own, "key", "left").join(file, "file_key", "left").select("key", F.coalesce("own", "of_file").alias("view_key"))


def innermost(spans: DataFrame, points: DataFrame, grain: float) -> DataFrame:
    """point_id and span_id: for each point the shortest span of its group that covers it, then the one that begins last, then the
    least id. spans: grp, span_id, lo, hi; points: grp, point_id, at.

    Both sides meet in buckets of `grain` units, so only near rows are compared; a span stands in each bucket it touches."""
    bucket = lambda c: F.floor(F.col(c) / grain).cast("long")
    a = spans.withColumn("bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    b = points.withColumn("bucket", bucket("at"))
    met = b.join(a, ["grp", "bucket"]).where("at between lo and hi and point_id <> span_id")
    best = met.groupBy("point_id").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("size"), (-F.col("lo")).alias("later"), "span_id")).alias("m"))
    return best.select("point_id", F.col("m.span_id").alias("span_id"))
