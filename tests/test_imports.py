"""Imports on made-up repositories: every rule of the five languages, and the sorted join that finds closest paths."""

import random

import pytest

from loomgraph.operators import imports as im
from loomgraph.operators import paths as pp

FILES = {
    "a/main.lua": """local m = require "pkg.mod"\nrequire('util')\nlocal t = require"gone.lib"\n-- require "pkg.mod2"\n--[[ require "x" ]] s = "it's \\" require 'y'" require [[no]] local z = require ( "pkg.init2" )""",
    "lib/pkg/mod.lua": "", "lib/util.lua": "", "a/util.lua": "", "b/pkg/init2/init.lua": "--[[ never closed require 'a'",
    "bin/run.sh": """# . ./no.sh\n. ./env.sh\nsource "../etc/conf.sh"\n  source tools/x.sh # source ./no.sh\necho ". ./no.sh"; x='\n'\n. $HOME/no.sh\necho a#b\n. ../../up.sh\n""",
    "bin/env.sh": ". ./env.sh", "etc/conf.sh": "", "share/tools/x.sh": "", "bin/no.sh": "", "deep/up.sh": "",
    "web/site.scss": """@import "vars";\n@use url( 'sub/part' );\n@forward "/web/top.css";\n@import 'https://x.org/a.css'; @import "//cdn/x"; @import "../../off";""",
    "web/vars.less": "", "web/vars.sass": "", "web/sub/_part.scss": "", "web/top.css": "",
    "docs/a.md": """[x](b.md#part) [y](</docs/c d.md>) [z](c%20d.md) [w](sub/)\n[ref]: <../bin/run.sh>\n [r2]: sub\n[bad](100%.md) [u](http://x.org) [h](#here) [plus](p+q.md)""",
    "docs/b.md": "", "docs/c d.md": "", "docs/sub/README.md": "", "docs/100%.md": "", "docs/p+q.md": "",
    "web/index.html": """<script src="app.js?v=2"></script><SCRIPT type=module src='/web/lib/'></SCRIPT><link rel="x" href=top><img alt="src=" src="pic.png"><a href="b.html">\nimport {a} from "./mod" import "./typed.mjs" <iframe src="mailto:x@y"></iframe>""",
    "web/app.ts": "", "web/lib/index.jsx": "", "web/mod/index.d.ts": "", "web/typed.mts": "", "web/b.html": "",
    "notes.txt": 'require "util"', "null.lua": None,
}
WANT = {
    ("a/main.lua", "pkg.mod", "lib/pkg/mod.lua", None), ("a/main.lua", "util", "a/util.lua", None), ("a/main.lua", "gone.lib", None, "gone"), ("a/main.lua", "pkg.init2", "b/pkg/init2/init.lua", None),
    ("bin/run.sh", "./env.sh", "bin/env.sh", None), ("bin/run.sh", "../etc/conf.sh", "etc/conf.sh", None), ("bin/run.sh", "tools/x.sh", "share/tools/x.sh", None), ("bin/run.sh", "../../up.sh", "deep/up.sh", None),
    ("bin/env.sh", "./env.sh", "bin/env.sh", None),
    ("web/site.scss", "vars", "web/vars.sass", None), ("web/site.scss", "sub/part", "web/sub/_part.scss", None), ("web/site.scss", "/web/top.css", "web/top.css", None),
    ("docs/a.md", "b.md#part", "docs/b.md", None), ("docs/a.md", "c%20d.md", "docs/c d.md", None), ("docs/a.md", "sub/", "docs/sub/README.md", None), ("docs/a.md", "../bin/run.sh", "bin/run.sh", None),
    ("docs/a.md", "sub", "docs/sub/README.md", None), ("docs/a.md", "100%.md", "docs/100%.md", None), ("docs/a.md", "p+q.md", "docs/p+q.md", None),
    ("web/index.html", "app.js?v=2", "web/app.ts", None), ("web/index.html", "/web/lib/", "web/lib/index.jsx", None), ("web/index.html", "./mod", "web/mod/index.d.ts", None),
    ("web/index.html", "./typed.mjs", "web/typed.mts", None),
}


@pytest.fixture(scope="module")
def resolved(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    return im.resolve_paths(im.imports_of(files), files)


def test_resolved(resolved):
    assert {(r["path"], r["spec"], r["target"], r["lib"]) for r in resolved.collect()} == WANT


def test_edges(resolved):
    got = {(r["s"], r["t"]): r["type"] for r in im.import_edges(resolved).collect()}
    assert got["f:docs/a.md", "f:docs/b.md"] == 1 and got["f:a/main.lua", "l:gone"] == 3 and ("f:bin/env.sh", "f:bin/env.sh") not in got
    assert len(got) == len({(p, t or lib) for p, _, t, lib in WANT if p != t})


def test_order_within_a_text(spark):
    got = im.imports_of(spark.createDataFrame([("x.lua", "require 'b' require 'a' require 'b'")], "path string, text string")).orderBy("n").collect()
    assert [(r["n"], r["spec"]) for r in got] == [(0, "b"), (1, "a"), (2, "b")]


def test_long_strings(spark):
    """Neither long strings nor long comments grow the stack of the expression's matcher."""
    text = 's = "' + "a\\\\b" * 200_000 + '" require "x" -- ' + "c" * 500_000 + "\n--[[" + "d\n" * 300_000 + "]] require 'y'"
    got = im.imports_of(spark.createDataFrame([("x.lua", text)], "path string, text string")).collect()
    assert [r["spec"] for r in got] == ["x", "y"]


def closest(paths, start, suffix):
    def alike(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    own = sorted(p for p in set(paths) if p == suffix or p.endswith("/" + suffix))
    return max(own, key=lambda p: alike(p, start)) if own else None


@pytest.mark.parametrize("parts", ["1", "4", "7"])
def test_closest(spark, parts):
    """A suffix that most files have, over several ranges of the sort, ties and paths without a match."""
    rng = random.Random(int(parts))
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    paths = list({"/".join([*(name() for _ in range(rng.randint(0, 4))), rng.choice(["init.lua", "init.lua", "x.lua", "aé.lua"])]) for _ in range(400)})
    asked = [("/".join(name() for _ in range(rng.randint(1, 4))), rng.choice(["init.lua", "x.lua", "aé.lua", "none.lua", f"{name()}/init.lua"])) for _ in range(300)] + [("", "init.lua"), ("b" * 9, "init.lua")]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = pp.closest_path(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(asked, "from string, suffix string"))
        assert {(r["from"], r["suffix"]): r["match"] for r in got.collect()} == {a: m for a in set(asked) if (m := closest(paths, *a))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


MORE = {
    "src/app/main.ts": """import a from './util'\nimport {b} from "../lib/x.js"; export * from "@/conf"; const c = require('lodash/fp')\nimport d from '@scope/pkg/deep'; import "node:fs"; import('src/lib/lazy') // import './no'\nconst s = "import './no'"; import e from `/top`; import f from "https://x.org/y.js"; import g from './none'; import h from '~/none'""",
    "src/app/util/index.tsx": "", "src/lib/x.ts": "", "src/conf.json": "", "src/lib/lazy.mjs": "", "top.js": "",
    "pkg/mod.py": """import os, typing as t\nfrom . import sib, other\nfrom .sub.deep import (name, # no\n  second)\nfrom pkg.sib import thing\nfrom .. import up\n'''\nimport no\n'''\n# import no\nimport standalone""",
    "pkg/__init__.py": "", "pkg/sib.py": "", "pkg/typing.py": "", "pkg/sub/__init__.py": "", "pkg/sub/deep.py": "", "tools/standalone.py": "",
    "src/a.c": """#include "b.h"\n #include <stdio.h>\n#include <proj/api.h>\n# include <cfg.h>\n#include "deep/none.h"\n// #include "no.h"\n/* \n#include "no.h"\n*/\n#include "../inc/up.h"\n""",
    "src/b.h": "", "include/proj/api.h": "", "other/cfg.h": "", "lib/include/cfg.h": "", "no.h": "", "inc/up.h": "",
    "a/Prog.cs": "using System.Text;\n// using No;\nglobal using static My.Lib;\nusing X = Other.Thing;",
    "a/App.swift": "@testable import Core\nimport struct Foundation.Date\n// import No",
    "lib/main.dart": """import 'dart:io';\nimport 'package:app/src/w.dart';\nimport 'package:http/http.dart';\nexport 'src/w.dart';\nimport "gone.dart";""", "lib/src/w.dart": "",
    "app/r.rb": """require_relative '../lib/one'\nrequire "two"\nload('json/pure')\nrequire_relative 'gone'\n# require 'no'\n=begin\nrequire 'no'\n=end\nrequire 'app/r'""", "lib/one.rb": "", "gems/x/lib/two.rb": "", "app/two.rb": "",
    "web/i.php": """<?php\nuse App\\Models\\User;\nuse function Vendor\\Pkg\\f;\nuse Alone;\nrequire_once 'inc/head.php';\ninclude('../shared/foot.php');\n// use No\\Way;\n""", "src/Models/User.php": "", "web/inc/head.php": "", "x/shared/foot.php": "",
}
MORE_WANT = {
    ("src/app/main.ts", "./util", "src/app/util/index.tsx", None), ("src/app/main.ts", "../lib/x.js", "src/lib/x.ts", None), ("src/app/main.ts", "@/conf", "src/conf.json", None), ("src/app/main.ts", "lodash/fp", None, "lodash"),
    ("src/app/main.ts", "@scope/pkg/deep", None, "@scope/pkg"), ("src/app/main.ts", "node:fs", None, "fs"), ("src/app/main.ts", "src/lib/lazy", "src/lib/lazy.mjs", None), ("src/app/main.ts", "/top", "top.js", None),
    ("pkg/mod.py", "os", None, "os"), ("pkg/mod.py", "typing", None, "typing"), ("pkg/mod.py", ".sib", "pkg/sib.py", None), ("pkg/mod.py", ".other", "pkg/__init__.py", None), ("pkg/mod.py", ".", "pkg/__init__.py", None),
    ("pkg/mod.py", ".sub.deep.name", "pkg/sub/deep.py", None), ("pkg/mod.py", ".sub.deep.second", "pkg/sub/deep.py", None), ("pkg/mod.py", ".sub.deep", "pkg/sub/deep.py", None), ("pkg/mod.py", "pkg.sib.thing", "pkg/sib.py", None), ("pkg/mod.py", "pkg.sib", "pkg/sib.py", None),
    ("pkg/mod.py", "standalone", "tools/standalone.py", None),
    ("src/a.c", "b.h", "src/b.h", None), ("src/a.c", "<stdio.h", None, "stdio"), ("src/a.c", "<proj/api.h", "include/proj/api.h", None), ("src/a.c", "<cfg.h", "lib/include/cfg.h", None), ("src/a.c", "../inc/up.h", "inc/up.h", None),
    ("a/Prog.cs", "System.Text", None, "System"), ("a/Prog.cs", "My.Lib", None, "My"), ("a/Prog.cs", "Other.Thing", None, "Other"), ("a/App.swift", "Core", None, "Core"), ("a/App.swift", "Foundation.Date", None, "Foundation"),
    ("lib/main.dart", "dart:io", None, "dart:io"), ("lib/main.dart", "package:app/src/w.dart", "lib/src/w.dart", None), ("lib/main.dart", "package:http/http.dart", None, "http"), ("lib/main.dart", "src/w.dart", "lib/src/w.dart", None),
    ("app/r.rb", "rel:../lib/one", "lib/one.rb", None), ("app/r.rb", "two", "gems/x/lib/two.rb", None), ("app/r.rb", "json/pure", None, "json"), ("app/r.rb", "app/r", "app/r.rb", None),
    ("web/i.php", "App\\Models\\User", "src/Models/User.php", None), ("web/i.php", "Vendor\\Pkg\\f", None, "Vendor"), ("web/i.php", "inc/head.php", "web/inc/head.php", None), ("web/i.php", "../shared/foot.php", "x/shared/foot.php", None),
}


def test_more_languages(spark):
    files = spark.createDataFrame(list(MORE.items()), "path string, text string")
    got = {(r["path"], r["spec"], r["target"], r["lib"]) for r in im.resolve_paths(im.imports_of(files), files).collect()}
    assert sorted(got - MORE_WANT, key=repr) == [] and sorted(MORE_WANT - got, key=repr) == []


def test_candidates_are_made_once(spark):
    """The rows that the sorted joins read twice are written, so the result's own plan makes no candidates any more."""
    asked = spark.createDataFrame([("a/x.lua", "lua", "m"), ("b/x.lua", "lua", "m")], "path string, grp string, spec string")
    found = im.resolve_paths(asked, spark.createDataFrame([("a/m.lua",), ("b/m.lua",), ("a/x.lua",)], "path string"))
    assert sorted((r["path"], r["target"]) for r in found.collect()) == [("a/x.lua", "a/m.lua"), ("b/x.lua", "b/m.lua")]
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_all_names_of_a_from(spark):
    """Python's `from` leads to as many modules as it names."""
    names = [f"m{k}" for k in range(9)]
    files = spark.createDataFrame([("pkg/a.py", "from . import " + ", ".join(names)), *((f"pkg/{n}.py", "") for n in names), ("pkg/__init__.py", "")], "path string, text string")
    edges = {(r["s"], r["t"]) for r in im.import_edges(im.resolve_paths(im.imports_of(files), files)).collect()}
    assert edges == {("f:pkg/a.py", f"f:pkg/{n}.py") for n in [*names, "__init__"]}
