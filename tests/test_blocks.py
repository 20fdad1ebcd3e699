"""Body ends and enclosing definitions against a line-by-line walk."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import blocks as b


def width(s):
    n = 0
    for c in s:
        if c not in " \t":
            break
        n += b.TAB if c == "\t" else 1
    return n


def walk(lines, d, grp):
    """The last line of the body of the definition on line d."""
    own, end, untouched = width(lines[d]), d, True
    skip = b.SKIPPED.get(grp)
    for k in range(d + 1, len(lines)):
        t = lines[k].strip()
        if not t:
            continue
        w = width(lines[k])
        if w < own:
            return end
        if w > own:
            end, untouched = k, False
        elif skip and re.search(skip, t):
            continue
        elif t[0] == "{" and untouched:
            end, untouched = k, False
        elif t[0] in "})]":
            end, untouched = k, False
            if not re.search(r"(?:[{(\[:]|=>)$", t):
                return end
        else:
            return k if re.match(r"end\b", t) else end
    return end


def ends(spark, files):
    lines = b.lines_of(spark.createDataFrame([(f, g, t) for f, (g, t) in files.items()], "file string, grp string, text string"))
    return {(r["file"], r["line"]): r["end"] for r in b.block_ends(lines, lines.where("trim(text) <> ''")).collect()}


PARTS = ["x = 1", "def f", "{", "}", "} else {", ")", "]: (", "end", "ender", "case 1:", "default :", "label:", "a::", "#if", "when x", "else", "});", "{ x }"]


@pytest.mark.parametrize("seed", range(2))
def test_against_a_walk(spark, seed):
    rng = random.Random(seed)
    files = {}
    for k in range(120):
        made = []
        for _ in range(rng.randint(1, 25)):
            lead = rng.choice(["", "", "  ", "    ", "\t", "\t  "])
            made.append("" if rng.random() < 0.1 else "  " if rng.random() < 0.05 else lead + rng.choice(PARTS))
        files[f"f{k}"] = (rng.choice(["js", "c", "py", "rb", None]), "\n".join(made))
    want = {(f, d): walk(t.split("\n"), d, g) for f, (g, t) in files.items() for d, s in enumerate(t.split("\n")) if s.strip()}
    assert ends(spark, files) == want


def test_shapes(spark):
    files = {
        "braces": ("js", "function f()\n{\n  a\n}\nnext"), "gnu": ("c", "foo(void)\n{\n#if X\n  a;\n#endif\n}\nint g;"), "py": ("py", "class A:\n  def f(self):\n    x\n\n  y = 1\n\n# end\nz"),
        "ruby": ("rb", "def f\n  a\nrescue\n  b\nend\ndef g"), "chain": ("js", "if (a) {\n  b\n} else {\n  c\n}\nd"), "label": ("go", "func f() {\n\tx\nout:\n\ty\n}\n"), "tail": ("c", "int f()\n  a\n#endif\n#if 1"), "one": ("py", "x")}
    got = ends(spark, files)
    assert [got[f, 0] for f in files] == [3, 5, 4, 4, 4, 4, 1, 0] and got["py", 1] == 2


def test_enclosing(spark):
    rng = random.Random(5)
    spans, want = [], {}
    for f in range(40):
        line, stack = 0, []
        for nth in range(rng.randint(1, 30)):
            line += rng.randint(0, 3)
            end = line + rng.choice([0, 1, 2, 5, 9, 30])
            while stack and stack[-1][1] < line:
                stack.pop()
            want[f"f{f}", nth] = stack[-1][0] if stack else None
            stack.append((nth, end))
            spans.append((f"f{f}", nth, line, end))
    got = b.enclosing(spark.createDataFrame(spans, "file string, nth int, line int, end int"))
    assert {(r["file"], r["nth"]): r["up"] for r in got.collect()} == want


def test_a_million_lines(spark):
    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(499_999)), lambda k: F.concat(F.repeat(F.lit(" "), (k % 40).cast("int")), F.lit("def f\n x"))), "\n"), F.lit("\nend"))
    files = spark.range(1).select(F.lit("big").alias("file"), F.lit("py").alias("grp"), text.alias("text"))
    began = time.perf_counter()
    lines = b.lines_of(files)
    got = b.block_ends(lines, lines.where("text like '%def%' and line % 1000 < 80")).agg(F.count("*"), F.max(F.col("end") - F.col("line")), F.sum(F.col("end") - F.col("line"))).first()
    assert got[0] == 40_000 and time.perf_counter() - began < 240
    assert got[1:] == (79, 79_000)  # bodies of the outermost depth, one in forty
