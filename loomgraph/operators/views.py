"""Filtered views of a graph, degrees and default nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import is_test

REF, CONTAIN, DEP = 1, 2, 3
STRUCT = ("dir", "file", "lib")
#: Kinds that very many edges may end in, and how many of their nodes are handed on to the edges.
HUBS, MOST_HUBS = ("lib", "keyword"), 10_000
#: Fixed: what counts as minor follows the kinds of files that repositories use.
MINOR = r"(?i)(^|/)(tests?|__tests__|spec|specs|examples?|docs?|benchmarks?|fixtures?|scripts?)/|[._-](test|spec)s?\.|^test_|\.(md|json|ya?ml|toml|txt|html?|css)$"


def kept_kind(view: str) -> Column:
    kind = F.col("kind")
    return {"files": kind.isin(*STRUCT), "words": kind.isin("file", "keyword"), "code": ~kind.isin("dir", "keyword")}[view]


def hidden_by() -> Column:
    """The toggle that would hide a node: tests before vars before libs; null if none."""
    path = F.when(F.col("kind") == "dir", F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    test = (F.col("kind") != "lib") & (F.col("path") != "") & is_test(path)
    return F.when(test, "tests").when(F.col("kind") == "variable", "vars").when(F.col("kind") == "lib", "libs")


def _hidden(hide: tuple[str, ...]) -> Column:
    """Whether one of the toggles (tests, vars, libs) hides a node."""
    flags = {"tests": hidden_by() == "tests", "vars": F.col("kind") == "variable", "libs": F.col("kind") == "lib"}
    out = F.lit(False)
    for h in hide:
        if h in flags:
            out = out | F.coalesce(flags[h], F.lit(False))
    return out


def _flagged(nodes: DataFrame, view: str, hide: tuple[str, ...]) -> DataFrame:
    """nodes with _shown, and _open for those whose own kind doesn't matter. If the toggles hide all nodes of the view's kinds, none of them counts; that is a row
    of the plan, not a job ahead of it."""
    if not hide:
        return nodes.withColumn("_shown", kept_kind(view)).withColumn("_open", F.lit(True))
    some = nodes.agg(F.coalesce(F.bool_or(kept_kind(view) & ~_hidden(hide)), F.lit(False)).alias("_any"))
    test = F.coalesce(hidden_by() == "tests", F.lit(False)) if "tests" in hide else F.lit(False)
    return nodes.crossJoin(F.broadcast(some)).withColumn("_shown", kept_kind(view) & (~_hidden(hide) | ~F.col("_any"))).withColumn("_open", ~test | ~F.col("_any")).drop("_any")


def view_nodes(nodes: DataFrame, view: str, hide: tuple[str, ...] = ()) -> DataFrame:
    """Nodes that the view shows. hide: toggles out of tests, vars and libs; if they hide everything, none of them counts."""
    return _flagged(nodes, view, hide).where("_shown").drop("_shown", "_open")


def view_edges(nodes: DataFrame, edges: DataFrame, view: str, hide: tuple[str, ...] = ()) -> DataFrame:
    """s, t and the strongest type between nodes that the view shows. The files view lifts links to their files; edges to
    keywords belong to the words view alone; hiding refs doesn't touch the words view.

    A node knows whether it, and with the same path its file, is shown; so two joins and one grouping do. Where nothing is lifted they only ask whether the ends are
    shown. Libraries and keywords, which very many edges may end in, are met first and where the edges are; the join by s comes last, and the grouping stays in its parts."""
    flagged = _flagged(nodes, view, hide)
    e = edges.where(F.col("type") != REF) if "refs" in hide and view != "words" else edges
    word = F.col("kind") == "keyword"
    if view != "files":
        shown = flagged.where("_shown")
        e = _met(e, shown.where(word if view == "words" else ~word).select(F.col("key").alias("t"), "kind"), "left_semi")
        return e.join(shown.select(F.col("key").alias("s")), "s", "left_semi").where("s <> t").groupBy("s", "t").agg(F.max("type").alias("type"))
    struct = F.col("kind").isin(*STRUCT)
    key = F.when(struct, F.col("key")).otherwise(F.col("file_key"))
    lifted = F.when(struct, F.col("_shown")).otherwise(F.col("_open") & F.col("file_key").isNotNull())
    info = flagged.select(F.col("key").alias("_k"), key.alias("_as"), lifted.alias("_there"), "_shown", "kind").where("_shown or _there")
    end = lambda x, df: df.select(F.col("_k").alias(x), *(F.col(c).alias(f"{x}{c}") for c in ("_as", "_there", "_shown")), "kind")
    e = _met(e, end("t", info.where(~word)), "inner").join(end("s", info).drop("kind"), "s")
    own = F.col("type") == CONTAIN  # containment isn't lifted
    for x in ("s", "t"):
        e = e.where(F.when(own, F.col(f"{x}_shown")).otherwise(F.col(f"{x}_there")))
    e = e.select(*(F.when(own, F.col(x)).otherwise(F.col(f"{x}_as")).alias(x) for x in ("s", "t")), "type")
    return e.where("s <> t").groupBy("s", "t").agg(F.max("type").alias("type"))


def _met(edges: DataFrame, ends: DataFrame, how: str) -> DataFrame:
    """edges joined with their ends (t, kind, ...) by t: a bounded number of hubs goes to the edges, so those of a hub don't meet in one task; the rest meets as usual."""
    hub = F.col("kind").isin(*HUBS)
    few = ends.where(hub).orderBy("t").limit(MOST_HUBS).drop("kind")
    rest = ends.join(F.broadcast(few.select("t")), "t", "left_anti").drop("kind")
    others = edges.join(F.broadcast(few.select("t")), "t", "left_anti")
    return edges.join(F.broadcast(few), "t", how).unionByName(others.join(rest, "t", how))


def reveal(nodes: DataFrame, view: str, hide: tuple[str, ...] = ()) -> DataFrame:
    """key, view, toggle and view_key of every node: where it is to be seen from a view with hidden toggles. A node that is shown stays; else the toggle that
    hides it is lifted in the view of its kind, or that view is taken; a node that its own view leaves out is its file there, if that is shown."""
    want = F.when(F.col("kind") == "dir", "files").when(F.col("kind") == "keyword", "words").otherwise("code")
    block = F.when(F.lit("tests" in hide) & (hidden_by() == "tests"), "tests").when(F.lit("vars" in hide) & (F.col("kind") == "variable"), "vars").when(F.lit("libs" in hide) & (F.col("kind") == "lib"), "libs")
    flagged = _flagged(nodes, view, hide).select("key", "file_key", "_shown", want.alias("want"), block.alias("block"))
    files = flagged.where("_shown").select(F.col("key").alias("file_key"), F.lit(True).alias("_file"))
    met = flagged.join(files, "file_key", "left")
    moved = ~F.col("_shown") & (F.col("block").isNotNull() | (F.col("want") != view))
    return met.select("key", F.when(moved, F.col("want")).otherwise(view).alias("view"), F.when(~F.col("_shown"), F.col("block")).alias("toggle"),
                      F.when(F.col("_shown") | moved, F.col("key")).when(F.col("_file"), F.col("file_key")).alias("view_key"))


def both_ends(edges: DataFrame) -> DataFrame:
    """u and w: each edge from either end."""
    return edges.select(F.explode(F.array(F.struct(F.col("s").alias("u"), F.col("t").alias("w")), F.struct(F.col("t").alias("u"), F.col("s").alias("w")))).alias("e")).select("e.u", "e.w")


def degree(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """key and deg of every node shown; opposite edges count twice."""
    return degree_of(shown, both_ends(edges))


def degree_of(shown: DataFrame, ends: DataFrame) -> DataFrame:
    """The same from both_ends(edges)."""
    counts = ends.groupBy("u").agg(F.count("*").alias("n"))
    return shown.select("key").join(counts, F.col("key") == F.col("u"), "left").select("key", F.coalesce("n", F.lit(0)).alias("deg"))


def default_node(nodes: DataFrame, degrees: DataFrame, view: str) -> DataFrame:
    """key and score of the node that a view begins with; ties by key."""
    if view == "files":
        return nodes.where("key = 'd:'").select("key", F.lit(0.0).alias("score"))
    kind = "keyword" if view == "words" else "file"
    minor = F.lit(False) if view == "words" else F.col("path").rlike(MINOR) | F.col("name").rlike(MINOR)
    scored = nodes.where(F.col("kind") == kind).select("key", "path", "name").join(degrees, "key").select("key", (F.col("deg") * F.when(minor, 0.15).otherwise(1.0)).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(1)


def edges_of(edges: DataFrame, key: str, direction: str) -> DataFrame:
    """key and type of the neighbours along out or in edges of a node."""
    here, there = ("s", "t") if direction == "out" else ("t", "s")
    names = F.create_map(*(F.lit(x) for x in (REF, "ref", CONTAIN, "contain", DEP, "dep")))
    return edges.where(F.col(here) == key).select(F.col(there).alias("key"), names[F.col("type")].alias("type"))


def stats(nodes: DataFrame) -> DataFrame:
    n = lambda test: F.count(F.when(test, 1))
    kind = F.col("kind")
    return nodes.agg(n(kind == "file").alias("files"), n(~kind.isin("dir", "file", "lib", "keyword")).alias("symbols"), n(kind == "lib").alias("libs"), n(kind == "keyword").alias("keywords"))
