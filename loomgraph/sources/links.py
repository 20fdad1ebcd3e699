"""Repository links: parsing, candidate splits, share links and permalinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST = "github.com"
SPEC = ("owner", "repo", "ref", "sub", "focus")


def _decoded(part: Column) -> Column:
    """Percent-decoded, or as it stands where that fails; a plus sign is no space."""
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def parse_link(link: Column, host: str = HOST) -> Column:
    """A struct of owner, repo, ref, sub and focus, or null."""
    s = F.regexp_replace(F.trim(link), "/+$", "")
    # fixed patterns: the links that are accepted
    full = r"(?i)^(?:https?://)?(?:www\.)?" + host.replace(".", r"\.") + r"/([^/\s]+)/([^/\s#?]+)(?:/(tree|blob|commit|releases/tag)/([^?#\s]+))?"
    short = r"^([\w.-]+)/([\w.-]+?)(?:\.git)?$"
    at = lambda k: F.regexp_extract(s, full, k)
    kind = F.lower(at(3))
    parts = F.transform(F.filter(F.split(at(4), "/"), lambda x: x != ""), _decoded)
    first = F.when(kind == "", "").otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), "/")
    of = lambda *v: F.struct(*(x.alias(n) for n, x in zip(SPEC, v)))
    none = F.lit("")
    return F.when(s.rlike(full), of(at(1), F.regexp_replace(at(2), r"\.git$", ""), first, F.when(kind == "tree", rest).otherwise(none), F.when(kind == "blob", rest).otherwise(none))).when(
        s.rlike(short), of(F.regexp_extract(s, short, 1), F.regexp_extract(s, short, 2), none, none, none))


def splits(specs: DataFrame, most: int = 6) -> DataFrame:
    """The columns of specs with k, and the ref, sub and focus of each candidate: the ref takes one to `most` segments."""
    parts = F.filter(F.concat(F.array("ref"), F.split(F.when(F.col("sub") != "", F.col("sub")).otherwise(F.col("focus")), "/")), lambda x: x != "")
    head = specs.where("ref = ''").withColumn("k", F.lit(1)).withColumn("ref", F.lit("HEAD"))
    some = specs.where("ref <> ''").withColumn("parts", parts)
    some = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(most)))))
    rest = F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), "/")
    tree = F.col("sub") != ""
    some = some.withColumns({"ref": F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/"), "sub": F.when(tree, rest).otherwise(F.lit("")), "focus": F.when(tree, F.lit("")).otherwise(rest)}).drop("parts")
    return head.unionByName(some)


def _encoded(path: Column) -> Column:
    """Percent-encoded segment by segment; spaces as %20."""
    return F.array_join(F.transform(F.split(path, "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")


def permalink(owner: str, repo: str, ref: str, kind: Column, path: Column, line: Column, end: Column, host: str = HOST) -> Column:
    """Of a file or, with its lines, a symbol; null for folders and pathless nodes. line, end: from 0."""
    lines = F.when(kind == "file", F.lit("")).otherwise(F.concat(F.lit("#L"), (line + 1).cast("string"), F.lit("-L"), (end + 1).cast("string")))
    return F.when((kind != "dir") & (path != ""), F.concat(F.lit(f"https://{host}/{owner}/{repo}/blob/{ref}/"), _encoded(path), lines))


def known_tree(specs: DataFrame, manifest: DataFrame) -> DataFrame:
    """The columns of specs with the ref, sub and focus of their first candidate that a manifest (owner, repo, ref, sub) knows; specs of
    which it knows none are left out."""
    given = ["owner", "repo", "ref", "sub", "focus"]
    asked = specs.withColumn("_spec", F.struct(*given))
    met = splits(asked).join(manifest.select("owner", "repo", "ref", "sub").distinct(), ["owner", "repo", "ref", "sub"])
    first = met.groupBy("_spec").agg(F.min(F.struct("k", "ref", "sub", "focus")).alias("m"))
    return first.select("_spec.owner", "_spec.repo", "m.ref", "m.sub", "m.focus")


def share_link(page: str, owner: Column, repo: Column, ref: Column, sub: Column, node: Column, view: Column, depth: Column) -> Column:
    """The address that leads back to a view; HEAD and empty parts are left out, repo if owner is null."""
    part = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}="), F.url_encode(value)))
    parts = [part("repo", F.concat(owner, F.lit("/"), repo)), part("ref", F.when(ref != "HEAD", ref)), part("path", sub), part("node", node), part("map", view), part("depth", depth.cast("string"))]
    return F.concat(F.lit(f"{page}?"), F.concat_ws("&", *parts))


def shared_view(link: Column) -> Column:
    """A struct of repo, ref, path, node, map and depth from such an address; null where a part is missing."""
    part = lambda name: F.try_url_decode(F.nullif(F.regexp_extract(link, rf"[?&]{name}=([^&#]*)", 1), F.lit("")))
    return F.struct(*(part(n).alias(n) for n in ("repo", "ref", "path", "node", "map")), part("depth").cast("int").alias("depth"))
