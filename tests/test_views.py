"""Toggles, the way to a hidden node, and searches with a budget, by hand."""

from loomgraph.operators import neighborhood, views
from loomgraph.plans import adapters

NODES = [
    ("d:", "dir", "r", "", None), ("d:tests", "dir", "tests", "tests", None), ("f:a", "file", "a.py", "src/a.py", "f:a"), ("f:t", "file", "t.py", "tests/t.py", "f:t"),
    ("s:f", "function", "f", "src/a.py", "f:a"), ("s:v", "variable", "v", "src/a.py", "f:a"), ("s:t", "function", "t", "tests/t.py", "f:t"), ("l:x", "lib", "x", "", None), ("k:w", "keyword", "w", "", None)]
EDGES = [("d:", "f:a", 2), ("f:a", "s:f", 2), ("s:f", "s:v", 1), ("s:f", "s:v", 3), ("s:t", "s:f", 3), ("s:f", "l:x", 3), ("s:v", "l:x", 1), ("f:a", "k:w", 1), ("s:f", "s:f", 3), ("s:f", "s:gone", 3)]


def tables(spark):
    return spark.createDataFrame(NODES, "key string, kind string, name string, path string, file_key string"), spark.createDataFrame(EDGES, "s string, t string, type int")


def edges(spark, *how):
    return {(r["s"], r["t"]): r["type"] for r in views.view_edges(*tables(spark), *how).collect()}


def test_edges(spark):
    assert edges(spark, "code") == {("f:a", "s:f"): 2, ("s:f", "s:v"): 3, ("s:t", "s:f"): 3, ("s:f", "l:x"): 3, ("s:v", "l:x"): 1}
    assert edges(spark, "code", ("vars", "tests")) == {("f:a", "s:f"): 2, ("s:f", "l:x"): 3}
    assert edges(spark, "files") == {("d:", "f:a"): 2, ("f:t", "f:a"): 3, ("f:a", "l:x"): 3}
    assert edges(spark, "files", ("tests",)) == {("d:", "f:a"): 2, ("f:a", "l:x"): 3}
    assert edges(spark, "files", ("refs", "libs")) == {("d:", "f:a"): 2, ("f:t", "f:a"): 3}
    assert edges(spark, "words") == edges(spark, "words", ("refs",)) == {("f:a", "k:w"): 1}


def test_hubs_are_met_where_edges_are(spark, monkeypatch):
    """Links into libraries don't meet by library, whether all or only some of them are handed on; the grouping stays with the join by s."""
    want = [edges(spark, *how) for how in (("code", ("refs",)), ("files",), ("words",))]
    for most in (0, 1):
        monkeypatch.setattr(views, "MOST_HUBS", most)
        assert [edges(spark, *how) for how in (("code", ("refs",)), ("files",), ("words",))] == want
    for view in ("code", "files", "words"):
        joins = [line for line in views.view_edges(*tables(spark), view)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line and "rightHint=(strategy=broadcast)" in line]
        assert any("LeftAnti, (t#" in line for line in joins)


def test_lines_travel_once(spark, sf):
    """Order lines aren't grouped ahead of their way to their order, nor sent on after it."""
    plan = adapters.star_edges(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(l_orderkey#" in plan and not any("p_brand" in line for line in plan.split("\n") if "hashpartitioning(l_orderkey" in line)


def test_everything_hidden(spark):
    """Where the toggles would hide all of a view, none of them counts, and the plan needs no job to know."""
    nodes, made = tables(spark)
    only = nodes.where("key in ('f:t', 's:t')")
    assert {r["key"] for r in views.view_nodes(only, "code", ("tests", "vars")).collect()} == {"f:t", "s:t"}
    more = spark.createDataFrame([("f:t", "s:t", 2)], "s string, t string, type int")
    assert [tuple(r) for r in views.view_edges(only, more, "code", ("tests",)).collect()] == [("f:t", "s:t", 2)]
    assert views.view_nodes(nodes.where("false"), "code", ("tests",)).count() == 0


def test_reveal(spark):
    way = lambda *how: {r["key"]: (r["view"], r["toggle"], r["view_key"]) for r in views.reveal(tables(spark)[0], *how).collect()}
    code = way("code", ("tests", "vars"))
    assert code["s:t"] == ("code", "tests", "s:t") and code["d:tests"] == ("files", "tests", "d:tests") and code["s:v"] == ("code", "vars", "s:v")
    assert code["s:f"] == ("code", None, "s:f") and code["d:"] == ("files", None, "d:") and code["k:w"] == ("words", None, "k:w") and code["l:x"] == ("code", None, "l:x")
    assert way("files", ())["s:f"] == ("code", None, "s:f") and way("words", ("libs",))["l:x"] == ("code", "libs", "l:x")
    everything = views.reveal(tables(spark)[0].where("key in ('f:t', 's:t')"), "code", ("tests",))
    assert {r["toggle"] for r in everything.collect()} == {None}  # nothing is hidden where all would be


def test_parents_in_a_budget(spark):
    links = [("a", x, 3) for x in "bcde"] + [("b", "p", 3), ("c", "p", 3), ("c", "q", 3), ("d", "q", 3), ("e", "q", 3), ("b", "r", 3)]
    e = spark.createDataFrame(links, "s string, t string, type int")
    shown = spark.createDataFrame([(k,) for k in "abcdepqr"], "key string")
    got = {r["key"]: (r["depth"], r["from"]) for r in neighborhood.budgeted(e, views.degree(shown, e), "a", 2, 5).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "p": (2, "b"), "q": (2, "c")}  # d and e, which also know q, weren't kept
    whole = {r["key"]: (r["depth"], r["from"]) for r in neighborhood.budgeted(e, views.degree(shown, e), "a", 2, 0).collect()}
    assert len(whole) == 8 and whole["q"] == (2, "c")
