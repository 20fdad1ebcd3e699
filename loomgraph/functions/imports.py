"""What a file's text imports, by language group, as column expressions: one regular expression per group reads comments and strings
over, so that only imports outside of them are found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: how a group writes an import; the first group of each pattern is what is taken of it.
IMPORT = {
    "js": [r"""(?:\bfrom|\bimport|\brequire\s*\(|\bimport\s*\()\s*['"`]([^'"`\n]+)['"`]"""],
    "py": [r"""^[ \t]*from[ \t]+(\.*[\w.]*[ \t]+import[ \t]*(?:\([^)]*\)|[^\n(]*))""", r"""^[ \t]*import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)"""],
    "c": [r"""^[ \t]*#[ \t]*include[ \t]*([<"][^>"\n]+)[>"]"""],
    "cs": [r"""^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?([\w.]+)[ \t]*;"""],
    "swift": [r"""^[ \t]*(?:@\w+[ \t]+)*import[ \t]+(?:(?:class|struct|enum|protocol|func|var|let|typealias)[ \t]+)?([\w.]+)"""],
    "dart": [r"""^[ \t]*(?:import|export|part)[ \t]+['"]([^'"]+)['"]"""],
    "rb": [r"""\b((?:require_relative|require|load)[ \t(]+['"][^'"]+)['"]"""],
    "php": [r"""^[ \t]*use[ \t]+(?:function[ \t]+|const[ \t]+)?([\w\\]+)""", r"""\b(?:require|include)(?:_once)?[ \t(]*['"]([^'"]+)['"]"""],
    "lua": [r"""\brequire[ \t(]*['"]([^'"]+)['"]"""],
    "sh": [r"""^[ \t]*(?:source|\.)[ \t]+["']?([^\s"';|&]+)"""],
    "css": [r"""@(?:import|use|forward)[ \t]+(?:url\()?[ \t]*['"]?([^'")\s;]+)"""],
    "md": [r"""\]\(\s*<?([^)\s>]+)""", r"""^\s*\[[^\]]+\]:\s*<?(\S+?)>?\s*$"""],
    "html": [
        r"""(?i)<(?:script|img|iframe|source|audio|video|embed)\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']""",
        r"""(?i)<link\b[^>]*?\bhref\s*=\s*["']([^"']+)["']""",
        r"""\bimport\s*(?:[\w{}\s*,]+from\s*)?["'](\.[^"']+)["']""",
    ],
}
#: What is read over first: comments, then strings. Possessive, as Java's stack would grow with a string otherwise.
_LINE, _QUOTED, _APOSTROPHES = r"//[^\n]*", r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?', r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
_BLOCK, _TICKS = r"/\*(?:[\s\S]*?\*/|[\s\S]*)", r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
_TRIPLE = r'"{3}(?:[\s\S]*?"{3}|[\s\S]*)'
OVER = {
    "js": [_BLOCK, _LINE, _QUOTED, _APOSTROPHES, _TICKS], "py": [_TRIPLE, r"'{3}(?:[\s\S]*?'{3}|[\s\S]*)", r"#[^\n]*", _QUOTED, _APOSTROPHES],
    "c": [_BLOCK, _LINE, _QUOTED], "cs": [_BLOCK, _LINE, _QUOTED], "swift": [_TRIPLE, _BLOCK, _LINE, _QUOTED], "dart": [_TRIPLE, _BLOCK, _LINE, _QUOTED, _APOSTROPHES],
    "rb": [r"=begin(?:[\s\S]*?=end|[\s\S]*)", r"#[^\n]*", _QUOTED, _APOSTROPHES], "php": [_BLOCK, _LINE, r"#[^\n]*", _QUOTED, _APOSTROPHES],
    "lua": [r"--\[\[(?:[\s\S]*?\]\]|[\s\S]*)", r"--[^\n]*", _QUOTED, _APOSTROPHES], "sh": [r"(?:^|\s)#[^\n]*", _QUOTED, _APOSTROPHES]}


def pattern(group: str, k: int = 0, over: bool = True) -> str:
    """A group's k-th pattern; lines end with \\n alone."""
    p = IMPORT[group][k]
    flags, p = ("(?mdi)", p[4:]) if p.startswith("(?i)") else ("(?md)", p)
    return flags + "|".join([*(OVER.get(group, []) if over else []), p])


def _written(group: str, k: int, found: Column) -> Column:
    """The specifiers in what a group's k-th pattern took."""
    if group == "py" and k == 0:  # from a.b import c, d: each name in its module, then the module
        def each(x):
            module = F.regexp_extract(x, r"^\.*[\w.]*", 0)
            names = F.regexp_replace(F.regexp_replace(x, r"^\.*[\w.]*[ \t]+import", ""), r"#[^\n]*|[()]", " ")
            known = F.filter(F.split(names, r"[,\s\\]+"), lambda n: n.rlike(r"^\w+$") & (n != "as"))
            dot = F.when(module.endswith("."), "").otherwise(".")
            return F.concat(F.transform(known, lambda n: F.concat(module, dot, n)), F.array(module))

        return F.flatten(F.transform(found, each))
    if group == "py":  # import a.b as c, d
        return F.flatten(F.transform(found, lambda x: F.transform(F.split(x, ","), lambda p: F.regexp_extract(p, r"[\w.]+", 0))))
    if group == "c":  # a quote goes, an angle stays
        return F.transform(found, lambda x: F.regexp_replace(x, '^"', ""))
    if group == "rb":
        return F.transform(found, lambda x: F.concat(F.when(x.startswith("require_relative"), "rel:").otherwise(""), F.regexp_replace(x, r"""^\w+[ \t(]+['"]""", "")))
    return found


def import_specs(group: Column, text: Column) -> Column:
    """The specifiers of a text in the order of the group's patterns, each as often as it stands; none for groups that have no pattern."""
    found = None
    for g, patterns in IMPORT.items():
        own = [F.filter(F.regexp_extract_all(text, F.lit(pattern(g, k)), F.lit(1)), lambda x: x != "") for k in range(len(patterns))]
        own = [_written(g, k, x) for k, x in enumerate(own)]
        specs = F.concat(*own) if len(own) > 1 else own[0]
        found = F.when(group == g, specs) if found is None else found.when(group == g, specs)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
