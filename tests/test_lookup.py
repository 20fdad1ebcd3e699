"""Clicks on lines by hand, and helpers of the catalogue that no later one of the same name replaces."""

import ast
from collections import Counter

from loomgraph.operators import lookup
from loomgraph.plans import catalogue


def test_helpers_have_names_of_their_own():
    with open(catalogue.__file__) as f:
        names = Counter(x.name for x in ast.parse(f.read()).body if isinstance(x, ast.FunctionDef))
    assert [n for n, k in names.items() if k > 1] == []


def test_line_click(spark):
    symbols = spark.createDataFrame([("a", "f", 0, 200), ("b", "f", 60, 70), ("c", "f", 64, 74), ("d", "f", 64, 74)], "key string, file_key string, line long, end long")
    clicks = spark.createDataFrame([(1, "f", 65), (2, "f", 72), (3, "f", 200), (4, "f", 201), (5, "g", 65)], "click_id long, file_key string, line long")
    assert {r["click_id"]: r["key"] for r in lookup.line_click(symbols, clicks).collect()} == {1: "b", 2: "c", 3: "a", 4: "f", 5: "g"}
