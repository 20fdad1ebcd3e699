"""Column functions over slash-separated paths: joining, suffixes, languages, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language groups by file extension and by whole file name.
EXTENSIONS = {
    "js": "js mjs cjs jsx ts tsx mts cts vue svelte astro",
    "py": "py pyi pyw",
    "go": "go",
    "rs": "rs",
    "c": "c h cc cpp cxx c++ hpp hh hxx h++ ino cu cuh m mm glsl vert frag comp geom hlsl metal",
    "jvm": "java kt kts scala sc groovy gradle",
    "cs": "cs",
    "swift": "swift",
    "dart": "dart",
    "rb": "rb rake gemspec ru",
    "php": "php phtml",
    "lua": "lua",
    "sh": "sh bash zsh ksh fish",
    "sql": "sql",
    "gen": "hs elm purs ml mli ex exs r jl nim pl pm tf hcl gd cr raku erl hrl clj cljs cljc edn lisp el scm rkt zig v sol fs fsx wgsl proto graphql gql d",
    "md": "md mdx markdown rst",
    "html": "html htm xhtml",
    "css": "css scss sass less styl",
    "text": "txt json jsonc json5 yaml yml toml ini cfg conf xml plist properties env cmake mk",
}
NAMES = {"rb": "gemfile rakefile podfile fastfile vagrantfile guardfile", "text": "makefile dockerfile license readme procfile justfile containerfile go.mod"}
# Folders and files that are not read.
SKIP_DIRS = "node_modules vendor dist build out target coverage __pycache__ venv env bower_components Pods DerivedData site-packages obj third_party external".split()
SKIP_FILES = "package-lock.json yarn.lock pnpm-lock.yaml cargo.lock poetry.lock go.sum composer.lock gemfile.lock pipfile.lock bun.lockb flake.lock".split()
#: Fixed patterns: generated files, and the names of tests.
SKIP_PATTERN = r"\.min\.(js|css)$|\.map$|\.bundle\.js$|\.lock$"
TEST_PATTERN = r"(^|/)(tests?|__tests__|spec|specs|testing|testdata|e2e)/|[._-](test|spec)s?\.[^/]+$|(^|/)test_[^/]*$|(^|/)conftest\.py$"
TEXT_GROUPS, TEXT_BYTES, CODE_BYTES = ("text", "md", "html", "css"), 250_000, 800_000


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def language_of(path: Column) -> Column:
    """The group by the whole name, else by the last extension; null for unknown ones and for names that begin with their only dot."""
    base = base_name(path)
    table = lambda by: F.create_map(*(F.lit(x) for g, names in by.items() for n in names.split() for x in (n, g)))
    dotted = F.regexp_extract(base, r"(?s)^.+\.([^.]*)$", 1)
    return F.coalesce(F.try_element_at(table(NAMES), base), F.try_element_at(table(EXTENSIONS), dotted))


def is_test(path: Column) -> Column:
    return path.rlike("(?i)" + TEST_PATTERN)


def wanted(path: Column, size: Column) -> Column:
    """Neither in a skipped or dotted folder nor a skipped file, of a known language and not too large for it."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bad = F.exists(folders, lambda s: s.isin(SKIP_DIRS) | (s.startswith(".") & (s != ".github")))
    base, lang = base_name(path), language_of(path)
    most = F.when(lang.isin(*TEXT_GROUPS), TEXT_BYTES).otherwise(CODE_BYTES)
    return ~bad & ~base.isin(SKIP_FILES) & ~base.rlike(SKIP_PATTERN) & lang.isNotNull() & (size <= most)


def path_join(folder: Column, relative: Column) -> Column:
    """Folder and relative path without "." and "..", or null where ".." leaves the root."""
    start = F.struct(F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/")).alias("at"), F.lit(True).alias("ok"))

    def step(a, s):
        up, n = s == "..", F.size(a["at"])
        at = F.when((s == "") | (s == "."), a["at"]).when(up, F.when(n > 0, F.slice(a["at"], F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(a["at"])).otherwise(F.concat(a["at"], F.array(s)))
        return F.struct(at.alias("at"), (a["ok"] & ~(up & (n == 0))).alias("ok"))

    return F.aggregate(F.split(relative, "/"), start, step, lambda a: F.when(a["ok"], F.array_join(a["at"], "/")))


def suffixes(path: Column) -> Column:
    """All whole-segment endings of a path, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def prefixes(path: Column) -> Column:
    """All whole-segment beginnings of a path, the shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
