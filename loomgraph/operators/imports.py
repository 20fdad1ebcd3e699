"""Imports to files: every language's rules as an ordered list of candidates, one equi-join with the paths for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.imports import import_specs
from loomgraph.functions.paths import language_of, path_join, suffixes
from loomgraph.operators._store import cut
from loomgraph.operators.paths import closest
from loomgraph.operators.views import DEP, REF

#: Endings that an import may leave out, in order; those that compiled names stand for; addresses that are no files.
SCRIPT_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte", ".json", ".css", ".scss", ".d.ts"]
TYPED_ENDINGS = [".ts", ".tsx", ".mts", ".cts"]
STYLE_ENDINGS = ["", ".css", ".scss", ".sass", ".less"]
EXTERNAL = r"(?i)^([a-z][\w+.-]*:|//|#)"


def imports_of(files: DataFrame) -> DataFrame:
    """path, grp, n (from 0) and spec of every import in files (path, text); null texts have none."""
    known = files.select("path", language_of(F.col("path")).alias("grp"), F.coalesce("text", F.lit("")).alias("text"))
    return known.select("path", "grp", F.posexplode(import_specs(F.col("grp"), F.col("text"))).alias("n", "spec"))


#: How a candidate is met: the whole path; an ending of a path; an ending below a folder for headers, or at the root; below a folder lib, or at the root;
#: below a folder that is no package itself.
EXACT, SUFFIX, HEADER, LIBRARY, TOP = range(5)


def _options(how: int, *paths: Column) -> Column:
    return F.array(*(F.struct(F.lit(how).alias("how"), p.alias("want")) for p in paths))


def _exact(*paths: Column) -> Column:
    return _options(EXACT, *paths)


def _with_endings(path: Column, endings: list[str]) -> Column:
    return F.transform(F.array(*map(F.lit, endings)), lambda e: F.struct(F.lit(EXACT).alias("how"), F.concat(path, e).alias("want")))


_COMPILED = r"\.[mc]?jsx?$"


def script_candidates(path: Column) -> Column:
    """The path, with an ending, as a folder's index, and its typed source where it names a compiled script."""
    p = F.regexp_replace(path, r"[?#].*$|/$|/?[?#].*$", "")
    inside = F.when(p == "", F.lit("index")).otherwise(F.concat(p, F.lit("/index")))
    typed = F.when(p.rlike(_COMPILED), F.regexp_replace(p, _COMPILED, ""))
    return F.concat(_with_endings(p, ["", *SCRIPT_ENDINGS]), _with_endings(inside, SCRIPT_ENDINGS), _with_endings(typed, TYPED_ENDINGS))


def _begun(parts: Column, least: int) -> Column:
    """The first k of the parts as a path, for k from all down to `least`; none if there are fewer."""
    n = F.size(parts)
    return F.transform(F.when(n >= least, F.sequence(n, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def _prepared(asked: DataFrame) -> DataFrame:
    """Adds what several candidates are made of: the specifier without what isn't part of a path (_clean), that from the file's folder (_join), or from the root if
    it begins there (_here)."""
    group, spec = F.col("grp"), F.col("spec")
    bare = F.substring_index(spec, "#", 1)
    plain = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    dots = F.length(F.regexp_extract(spec, r"^\.*", 0))
    clean = F.when(group == "md", F.when(plain.isNull() | plain.contains("\ufffd"), bare).otherwise(plain)).when(group.isin("html", "js"), F.regexp_replace(spec, "[?#].*$", "")).when(
        group == "c", F.regexp_replace(spec, "^<", "")).when(group == "php", F.regexp_replace(spec, r"^\./", "")).when(
        (group == "rb") & spec.startswith("rel:"), F.substr(spec, F.lit(5))).when(group == "py", F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise(F.lit(""))).otherwise(spec)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    joined = asked.withColumn("_clean", clean).withColumn("_join", path_join(folder, F.col("_clean")))
    return joined.withColumn("_here", F.when(F.col("_clean").startswith("/"), F.substring("_clean", 2, 1 << 30)).otherwise(F.col("_join")))


def _python(spec: Column, up: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(spec, r"^\.*", ""), r"\."), lambda x: x != "")
    base = lambda q: F.when(up == "", q).when(q == "", up).otherwise(F.concat(up, F.lit("/"), q))
    package = lambda b: F.when(b == "", F.lit("__init__.py")).otherwise(F.concat(b, F.lit("/__init__.py")))
    near = F.flatten(F.transform(_begun(parts, 0), lambda q: _exact(F.when(q != "", F.concat(base(q), F.lit(".py"))), package(base(q)))))
    far = F.flatten(F.transform(_begun(parts, 1), lambda q: _options(TOP, F.concat(q, F.lit(".py")), F.concat(q, F.lit("/__init__.py")))))
    return F.when(spec.startswith("."), near).otherwise(far)


def candidates() -> Column:
    """Where the file may be that a specifier (of a _prepared row) names, the best first: exact paths, or endings of paths."""
    group, spec, clean, joined, here = (F.col(c) for c in ("grp", "spec", "_clean", "_join", "_here"))
    local = ~spec.rlike(EXTERNAL)
    lua = F.replace(spec, F.lit("."), F.lit("/"))
    style = F.concat(_with_endings(here, STYLE_ENDINGS), _with_endings(F.regexp_replace(here, "^(.*/)?", "$1_"), STYLE_ENDINGS))
    page = F.regexp_replace(here, "/$", "")
    script = F.when(spec.rlike(r"^[./]"), script_candidates(here)).when(spec.rlike("^[@~#]/"), F.concat(script_candidates(F.concat(F.lit("src/"), F.substr(spec, F.lit(3)))), script_candidates(F.substr(spec, F.lit(3))))).otherwise(
        F.filter(script_candidates(spec), lambda c: c["want"].contains("/")))
    tail = F.regexp_replace(clean, r"^(\.\.?/)+", "")
    include = F.when(spec.startswith("<") & ~tail.contains("/"), _options(HEADER, tail)).otherwise(_options(SUFFIX, tail))
    ruby = F.when(spec.startswith("rel:"), _exact(F.concat(joined, F.lit(".rb")), joined)).otherwise(_options(LIBRARY, F.concat(F.regexp_replace(spec, r"\.rb$", ""), F.lit(".rb"))))
    spaces = F.filter(F.split(spec, r"\\"), lambda x: x != "")
    named = F.transform(F.sequence(F.lit(1), F.greatest(F.size(spaces) - 1, F.lit(1))), lambda k: F.struct(F.lit(SUFFIX).alias("how"), F.concat(F.array_join(F.slice(spaces, k, F.size(spaces)), "/"), F.lit(".php")).alias("want")))
    php = F.when(spec.rlike(r"/|\.php$"), F.concat(_exact(joined), _options(SUFFIX, F.regexp_replace(F.regexp_replace(clean, r"^(\.\./)+", ""), "^/", "")))).otherwise(named)
    rules = {
        "lua": _options(SUFFIX, F.concat(lua, F.lit(".lua")), F.concat(lua, F.lit("/init.lua"))),
        "sh": F.when(~spec.contains("$"), F.concat(_exact(joined), _options(SUFFIX, tail))), "css": F.when(local, style),
        "md": F.when(local, _exact(page, F.concat(page, F.lit("/README.md")))), "html": F.when(local, script_candidates(here)),
        "js": F.when((local | spec.rlike("^#/")) & ~spec.startswith("node:"), script), "py": _python(spec, joined), "c": F.concat(_exact(joined), include), "rb": ruby, "php": php,
        "dart": F.when(spec.startswith("package:"), _options(SUFFIX, F.concat(F.lit("lib/"), F.regexp_replace(spec, "^package:[^/]+/", "")))).when(~spec.startswith("dart:"), _exact(joined))}
    out = None
    for g, rule in rules.items():
        out = F.when(group == g, rule) if out is None else out.when(group == g, rule)
    return out


def library(group: Column, spec: Column) -> Column:
    """What a specifier names where no file is found; null where that is nothing."""
    first = lambda s, by: F.substring_index(s, by, 1)
    node = F.regexp_replace(spec, "^node:", "")
    package = F.when(node.startswith("@"), F.substring_index(node, "/", 2)).otherwise(first(node, "/"))
    name = F.when(group.isin("lua", "cs", "swift"), first(spec, ".")).when(
        (group == "js") & (~spec.rlike(EXTERNAL) | spec.startswith("node:")) & ~spec.rlike("^([./]|[@~#]/)"), package).when(
        (group == "py") & ~spec.startswith("."), first(spec, ".")).when(
        (group == "c") & spec.startswith("<"), F.regexp_replace(first(F.substr(spec, F.lit(2)), "/"), r"\.(h|hpp|hh)$", "")).when(
        (group == "dart") & spec.startswith("dart:"), spec).when((group == "dart") & spec.startswith("package:"), F.regexp_extract(spec, "^package:([^/]+)/", 1)).when(
        (group == "rb") & ~spec.startswith("rel:"), first(spec, "/")).when(
        (group == "php") & ~spec.rlike(r"/|\.php$") & spec.rlike(r"[^\\]\\+[^\\]"), F.regexp_extract(spec, r"[^\\]+", 0))
    return F.nullif(name, F.lit(""))


def resolve_paths(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """path, grp, spec, target (a path) and lib of each different import (path, grp, spec) that leads to a file of paths (path) or to a library."""
    asked = imports.select("path", "grp", "spec").distinct()
    options = _prepared(asked).select("path", "grp", "spec", F.posexplode(candidates()).alias("nth", "c")).select("path", "grp", "spec", "nth", "c.how", "c.want").where("want is not null")
    own = paths.select("path").distinct()
    ends = own.select("path", F.explode(suffixes(F.col("path"))).alias("want")).withColumn("ahead", F.expr("substr(path, 1, length(path) - length(want))"))
    # a folder that is a package itself doesn't hold modules of the top level
    inner = own.where("path like '%/\\_\\_init\\_\\_.py' or path = '__init__.py'").select(F.regexp_replace("path", r"__init__\.py$", "").alias("ahead"), F.lit(True).alias("inner"))
    ends = ends.join(inner, "ahead", "left")
    ways = {EXACT: F.col("ahead") == "", SUFFIX: F.lit(True), HEADER: F.col("ahead").rlike("^$|(^|/)(include|inc)/$"), LIBRARY: F.col("ahead").rlike("^$|(^|/)lib/$"), TOP: F.col("inner").isNull()}
    ends = ends.select("path", "want", F.explode(F.array_compact(F.array(*(F.when(test, how) for how, test in ways.items())))).alias("how"))
    met = options.join(ends.select("how", "want").distinct(), ["how", "want"])
    # what the sorted joins take is written, as they read it twice
    first = cut(met.groupBy("path", "grp", "spec").agg(F.min(F.struct("nth", "how", "want")).alias("m")).select("path", "grp", "spec", "m.how", "m.want"))
    key = F.concat(F.col("how").cast("string"), F.lit(":"), "want").alias("grp")
    near = first.where(F.col("how") != EXACT).select(key, F.col("path").alias("at")).distinct()
    known = cut(ends.where(F.col("how") != EXACT).select(key, F.col("path").alias("at")).join(near.select("grp").distinct(), "grp", "left_semi"))
    picked = closest(known, near).select(F.col("at").alias("path"), F.col("grp").alias("key"), "match")
    found = first.withColumn("key", F.concat(F.col("how").cast("string"), F.lit(":"), "want")).join(picked, ["path", "key"], "left").select("path", "grp", "spec", F.coalesce("match", "want").alias("target"))
    every = asked.join(found, ["path", "grp", "spec"], "left").withColumn("lib", F.when(F.col("target").isNull(), library(F.col("grp"), F.col("spec"))))
    return every.where("target is not null or lib is not null")


def import_edges(resolved: DataFrame) -> DataFrame:
    """s, t and type: each file's links to the files and libraries that it imports, itself apart; those of prose are weak."""
    t = F.coalesce(F.concat(F.lit("f:"), "target"), F.concat(F.lit("l:"), "lib"))
    kind = F.when((F.col("grp") == "md") & F.col("target").isNotNull(), REF).otherwise(DEP)
    return resolved.where("target is null or target <> path").select(F.concat(F.lit("f:"), "path").alias("s"), t.alias("t"), kind.alias("type")).distinct()
