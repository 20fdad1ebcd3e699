"""The test tables as a property graph, as files and as links."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators._store import large

REF, CONTAIN, DEP = 1, 2, 3
#: Symbols' kinds by order priority.
KINDS = {"1": "class", "2": "type", "3": "function", "4": "method", "5": "variable"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, key, name, path, parent_key and file_key: regions and nations are folders, customers files, orders symbols, brands libraries."""
    none = F.lit(None).cast("string")
    node = lambda df, kind, key, name, path, parent, file: df.select(kind.alias("kind"), key.alias("key"), name.alias("name"), path.alias("path"), parent.alias("parent_key"), file.alias("file_key"))
    folder = F.lit("dir")
    region = read(spark, sf_dir, "region")
    nation = read(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("path", F.concat_ws("/", "r_name", "n_name"))
    customer = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", F.col("path").alias("folder"))
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.substring("o_orderpriority", 1, 1)]
    file, file_path = F.concat(F.lit("f:"), "c_name"), F.concat_ws("/", "folder", "c_name")
    one = spark.range(1)
    parts = [
        node(one, folder, F.lit("d:"), F.lit("r"), F.lit(""), none, none),
        node(region, folder, F.concat(F.lit("d:"), "r_name"), F.col("r_name"), F.col("r_name"), F.lit("d:"), none),
        node(nation, folder, F.concat(F.lit("d:"), "path"), F.col("n_name"), F.col("path"), F.concat(F.lit("d:"), "r_name"), none),
        node(customer, F.lit("file"), file, F.col("c_name"), file_path, F.concat(F.lit("d:"), "folder"), file),
        node(order, kind, F.concat(F.lit("s:"), "o_orderkey"), F.col("o_orderkey").cast("string"), file_path, file, file),
        node(read(spark, sf_dir, "part").select("p_brand").distinct(), F.lit("lib"), F.concat(F.lit("l:"), "p_brand"), F.col("p_brand"), F.lit(""), none, none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_edges(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """s, t and type (the strongest of each pair): containment from the nodes, links from order lines to their parts' brands."""
    nodes = star_nodes(spark, sf_dir) if nodes is None else nodes
    contain = nodes.where("parent_key is not null").select(F.col("parent_key").alias("s"), F.col("key").alias("t"), F.lit(CONTAIN).alias("type"))
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customer = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    known = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    lines = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand", "l_returnflag")
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")  # few lines of an order are alike: grouped where they meet their order, in small parts
    links = lines.groupBy("l_orderkey", "p_brand").agg(F.max(F.when(F.col("l_returnflag") == "R", REF).otherwise(DEP)).alias("type"))
    links = links.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return contain.unionByName(links.select(F.concat(F.lit("s:"), "l_orderkey").alias("s"), F.concat(F.lit("l:"), "p_brand").alias("t"), "type"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and text."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


#: Folders and endings that listed paths take in turn.
FOLDERS = ["src", "tests", "node_modules", ".github", ".git", "docs", "lib/spec", "out"]
ENDINGS = [".txt", ".py", ".js", ".min.js", ".lock", ".go", ".RS", ".d.ts", ".zzz", ".test.ts", "/Makefile", "/.env", ".md", "_test.go", "/test_a.py"]


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and size of a made-up listing, a file per document."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("doc_id"), F.lit(by)) + 1).cast("int"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.select("doc_id", F.concat(F.col("source"), F.lit("/"), pick(FOLDERS, len(FOLDERS)), F.lit("/f"), F.col("doc_id").cast("string"), pick(ENDINGS, len(ENDINGS))).alias("path"), (F.col("n_chars") * 100).alias("size"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text of a repository made of the documents and pages: each text under a head of imports in one of five languages, which name
    other files of it (by folder, ending, alias or not at all), libraries, addresses, and imports in comments and strings."""
    docs = read(spark, sf_dir, "documents")
    own = lambda template: F.concat(*(F.col(x[1:]) if _PLACE.fullmatch(x) else F.lit(x) for x in template))
    ids = {f"i{k}": (F.col("doc_id") - k).cast("string") for k in (0, 6, 12, 60, -5, -11)}
    d = docs.withColumns({"source": F.coalesce("source", F.lit("")), "lang": F.coalesce("lang", F.lit("")), **ids}).withColumn("k", F.pmod("doc_id", F.lit(6)))
    path = (
        F.when(F.expr("k = 0 and doc_id % 12 = 0"), own(["src/", "@source", "/d", "@i0", "/util.lua"])).when(F.expr("k = 0 and doc_id % 18 = 6"), own(["src/", "@source", "/m", "@i0", "/init.lua"]))
        .when(F.col("k") == 0, own(["src/", "@source", "/m", "@i0", ".lua"])).when(F.col("k") == 1, own(["bin/", "@lang", "/s", "@i0", ".sh"]))
        .when(F.expr("k = 2 and doc_id % 4 = 2"), own(["web/", "@source", "/_c", "@i0", ".css"])).when(F.col("k") == 2, own(["web/", "@source", "/c", "@i0", ".scss"]))
        .when(F.expr("k = 3 and doc_id % 4 = 3"), own(["docs/p", "@i0", "/README.md"])).when(F.col("k") == 3, own(["docs/", "@source", "/", "@lang", "/p", "@i0", ".md"]))
        .when(F.col("k") == 4, own(["web/h", "@i0", ".html"])).when(F.expr("doc_id % 4 = 1"), own(["web/app", "@i0", "/index.js"])).otherwise(own(["web/app", "@i0", ".ts"])))
    heads = [own([x for x in _PLACE.split(h) if x]) for h in HEADS]
    head = F.element_at(F.array(*heads), (F.col("k") + 1).cast("int"))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("site/"), "page_id", F.lit(".html")).alias("path"), F.concat(F.lit('<link href="/web/app'), (F.col("page_id") * 6 + 5).cast("string"), F.lit('"/>'), F.coalesce("html", F.lit(""))).alias("text"))
    return d.where("doc_id is not null").select(path.alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text")).unionByName(pages)


_PLACE = re.compile(r"(@i-?\d+|@source|@lang)")
#: The heads of code_files, by doc_id modulo 6; @i6 is the doc_id less 6, and so on.
HEADS = [
    """local a = require "m@i6"
local b = require("src.@source.m@i12")
-- require "m@i12"
local s = "say \\" require 'x'" local u = require 'util'
local c = require 'socket.http', require 'src.@source.m@i60'
--[[
require "m@i6"
]]
""",
    """#!/bin/sh
. ./s@i6.sh
source "../@lang/s@i12.sh"
  source lib/common.sh # source ./x.sh
echo ". ./s@i12.sh"
. $HOME/x.sh
. ./s@i60.sh
. /etc/s@i6.sh
# . ./s@i12.sh
""",
    """@import "c@i6"; @import "c@i60";
@use url(../@source/c@i12.scss);
@import "https://x.org/a.css";
@forward '/web/@source/c@i6';
@import "../../../../c.css";
""",
    """[a](../@lang/p@i6.md) [b](</docs/p@i12>) [c](http://x.org/) [d](%70@i6.md#top) [e](100%.md) [f](p@i60.md)
[ref]: <../../p@i12/>
""",
    """<script async src="app@i-11.js?v=1"></script><LINK rel=x href='/web/app@i-5'><img src="//cdn/x.png">
<script>import { x, y } from "./app@i-5/index"; import "./h@i6.html"</script>
""",
    "export const n = @i0\n",
]


def symbol_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a linked code base: files are customers, definitions orders, uses order lines. Names are shared by very many definitions, by some
    or by one; files import those of near numbers."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    segment = F.create_map(*(F.lit(x) for pair in SEGMENT_GROUPS.items() for x in pair))[F.col("c_mktsegment")]
    files = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(F.lit("f:"), "c_custkey").alias("file"), segment.alias("grp"), F.col("n_name").alias("folder"),
        F.when(segment == "jvm", F.concat(F.lit("p"), F.pmod("c_nationkey", F.lit(5)))).alias("package"))
    own = order.join(large(files.select("c_custkey", "file")), F.col("o_custkey") == F.col("c_custkey"))
    first = own.where("o_orderpriority like '1%'").groupBy("file").agg(F.min("o_orderkey").alias("class"))
    key = F.concat(F.lit("s:"), "o_orderkey")
    name = F.expr("case o_orderkey % 5 when 0 then 'main' when 1 then concat('h', o_orderkey % 40) when 2 then concat('n', o_orderkey % 1000) when 3 then concat('a', o_orderkey) else concat('g', o_custkey % 300) end")
    inner = F.expr("o_orderpriority rlike '^[345]' and class < o_orderkey")
    defs = own.join(large(first), "file", "left").select(key.alias("key"), name.alias("name"), "file", F.when(inner, F.concat(F.lit("s:"), "class")).otherwise(F.col("file")).alias("parent_key"), (F.col("o_orderstatus") != "P").alias("shown"), "o_orderkey")
    said = F.expr("case l_linenumber % 5 when 0 then 'main' when 1 then concat('h', l_partkey % 40) when 2 then concat('n', l_partkey * 7 % 1000) when 3 then concat('a', l_orderkey + 3 - l_orderkey % 5) else concat('g', (l_suppkey * 3 + l_partkey) % 300) end")
    uses = line.join(large(own.select("o_orderkey", "file")), F.col("l_orderkey") == F.col("o_orderkey")).select("file", F.concat(F.lit("s:"), "l_orderkey").alias("owner"), said.alias("name"), (F.col("l_returnflag") == "R").alias("member"))
    imported = files.select("file", F.explode(F.expr("transform(array(c_custkey + 1, c_custkey + 5, c_custkey + 10, c_custkey * 2), x -> concat('f:', x))")).alias("target"))
    locals_ = own.where("o_orderkey % 3 = 0").select(key.alias("key"), F.explode(F.expr("array(concat('h', o_orderkey % 40), concat('n', o_orderkey % 1000), 'h1')")).alias("name"))
    external = files.where("c_custkey % 4 = 0").select("file", F.explode(F.expr("array(concat('h', c_custkey % 40), concat('g', c_custkey % 300), 'h3')")).alias("name"))
    return {"files": files.drop("c_custkey"), "defs": defs.drop("o_orderkey"), "uses": uses, "imported": imported, "locals": locals_, "external": external}


#: Language groups that market segments stand for.
SEGMENT_GROUPS = {"AUTOMOBILE": "go", "BUILDING": "jvm", "FURNITURE": "js", "HOUSEHOLD": "c", "MACHINERY": "py"}


def indented_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lines of the documents as those of source files (file, grp, line, text), with an indentation and a beginning that follow from their lengths, and
    those of them that define something (file, nth, line)."""
    docs = read(spark, sf_dir, "documents").where("doc_id is not null")
    grp = F.element_at(F.array(*map(F.lit, ["js", "py", "rb", "c", "go", "sql"])), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    lines = docs.select(F.col("doc_id").alias("file"), grp.alias("grp"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said"))
    size = F.length("said")
    lead = F.when(size == 0, "").otherwise(F.element_at(F.array(*map(F.lit, LEADS)), ((size * 7 + F.col("line") * 3) % len(LEADS) + 1).cast("int")))
    start = F.when(size == 0, "").otherwise(F.element_at(F.array(*map(F.lit, STARTS)), ((size + F.col("line")) % len(STARTS) + 1).cast("int")))
    made = lines.select("file", "grp", "line", F.concat(lead, start, F.when(size % 5 > 0, F.col("said")).otherwise(F.lit(""))).alias("text"), (size % 3 == 1).alias("defines"))
    return made.drop("defines"), made.where("defines").select("file", F.col("line").alias("nth"), "line")


#: What lines begin with in turn: indentations, then marks.
LEADS = ["", "  ", "", "    ", "\t", " \t", "", "  "]
STARTS = ["", "{", "}", "", "case x: ", "} else {", "end ", "# ", "", "rescue ", "tag:"]


def package_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Source files in packages, one per document, modules, definitions, and imports of both kinds (go, jvm: path, spec)."""
    d = read(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("i"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"))
    go = d.select("i", "source", "lang", F.expr("concat('go/', source, '/', lang, '/g', i, if(i % 7 = 0, '_test.go', '.go'))").alias("path"))
    jvm = d.select("i", "lang", F.expr("concat('java/', source, '/com/', lang, '/pkg', pmod(i, 5), '/C', i, if(i % 3 = 0, '.kt', '.java'))").alias("path"))
    modules = d.select("source").distinct().select(F.concat(F.lit("go/"), "source").alias("dir"), F.concat(F.lit("example.org/"), "source").alias("module")).unionByName(
        d.where("lang = 'en'").select("source").distinct().select(F.expr("concat('go/', source, '/en')").alias("dir"), F.expr("concat('example.org/', source, '/en/v2')").alias("module")))
    go_specs = F.array(*map(F.expr, ["concat('example.org/', source, '/', lang)", "concat('example.org/', source, '/en/v2')", "'fmt'", "concat('net/', lang)", "concat('github.com/a/', lang, '/c/d')", "concat('example.org/', source, '/none')", "concat('example.org/', source, 'x')"]))
    jvm_specs = F.array(*map(F.expr, ["concat('com.', lang, '.pkg', pmod(i + 1, 5), '.C', i - 4)", "concat('com.', lang, '.pkg', pmod(i, 5), '.*')", "concat('com.en.pkg', pmod(i, 5), '.T', pmod(i, 40))", "concat('com.', lang, '.pkg', pmod(i, 5), '.C', i, '.inner.deep')", "'org.junit.Test'", "'kotlin'", "concat('com.en.pkg1.T', i, 'x')"]))
    return {
        "files": go.select("path").unionByName(jvm.select("path")), "modules": modules,
        "defs": jvm.select(F.expr("concat('T', pmod(i, 40))").alias("name"), "path", (F.col("i") % 4 > 0).alias("top")),
        "go": go.select("path", F.explode(go_specs).alias("spec")), "jvm": jvm.select("path", F.explode(jvm_specs).alias("spec"))}
