"""Words of files against a plain walk, on odd texts and repeated keys, and what travels for them."""

import re
from collections import Counter

import pytest

from loomgraph.functions.text import STOP
from loomgraph.operators import keywords

TEXTS = ["parseXMLFile HTTPServerID fooBars berries bus glass", "9abc_defGhi2jkl studies Words wordS ABCd AAaAAa", "", None, "ünïcode naïveWords café\x00zebras İstanbul", "the cats\ncat CATS cat's ties dies series", "a b cd zzz zzz zzzs zzzss", "x" * 100 + "s " + "Ab" * 60]


def walk(rows):
    """doc_id, word: count, by the rule's two replacements on each identifier."""
    out = Counter()
    for doc, text in rows:
        for ident in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text or ""):
            parts = re.sub("([a-z])([A-Z])", r"\1 \2", re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", ident))
            for w in map(str.lower, re.findall("[A-Za-z]+", parts)):
                if len(w) > 4:
                    w = w[:-3] + "y" if w.endswith("ies") else w[:-1] if w.endswith("s") and not re.search("(ss|us|is|os)$", w) else w
                if len(w) >= 3 and w not in STOP:
                    out[doc, w] += 1
    return out


@pytest.mark.parametrize("repeated", [False, True])
def test_counts(spark, repeated, monkeypatch):
    monkeypatch.setattr(keywords, "HELD", 3)
    rows = [(None if repeated and k % 4 == 0 else k % 3 if repeated else k, t) for k, t in enumerate(TEXTS)]
    files = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n, single = keywords.sizes(files)
    assert (n, single) == (len(rows), not repeated)
    want = walk(rows)
    assert {(r["doc_id"], r["word"]): r["c"] for r in keywords.term_counts(files, single).collect()} == want
    assert {r["word"]: r["df"] for r in keywords.document_counts(files, single).collect()} == Counter(w for _, w in want)
    some = ["cat", "zzz", "word"]
    assert {(r["doc_id"], r["word"]): r["c"] for r in keywords.term_counts(files, single, some).collect()} == {k: c for k, c in want.items() if k[1] in some}
    assert keywords.sizes(files.where("false")) == (0, True) and keywords.document_counts(files.where("false"), True).count() == 0


def test_little_travels(spark):
    """Words of single files don't travel to be counted, only words of the vocabulary leave their reader, and texts stay for the mentions."""
    files = spark.createDataFrame([(k, f"common{'abc'[k % 3]} rare{chr(97 + k // 26)}{chr(97 + k % 26)}x often") for k in range(90)], "doc_id long, text string")
    assert "Exchange" not in keywords.term_counts(files, True)._jdf.queryExecution().executedPlan().toString()
    tops = keywords.top_words(files, 90, True)
    assert {r["word"] for r in tops.collect()} == {"commona", "commonb", "commonc"}
    found = keywords.mentions(files, tops)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2  # the vocabulary, and the words asked for
    assert found.count() == 90 and {r["line"] for r in found.collect()} == {0}


@pytest.mark.parametrize("most", [100, 1])
def test_shared_keys(spark, monkeypatch, most):
    """Where a few files share a doc_id, only their words travel to be added up; where too many do, all; the counts are the same."""
    monkeypatch.setattr(keywords, "SHARED", most)
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(None, "cats dogs"), (None, "cat birds"), (3, "parse cats"), (0, None), (7, "zzz zzz")]
    files = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n, single = keywords.sizes(files)
    assert (n, single) == (len(rows), False)
    want = walk(rows)
    counts, dfs, some = keywords.term_counts(files), keywords.document_counts(files), ["cat", "zzz"]
    for df in (counts, dfs):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("LeftAnti"), plan.count("LeftSemi")) == ((1, 1) if most > 4 else (0, 0))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["word"], r["c"]) for r in counts.collect()) == sorted((d is None, d, w, c) for (d, w), c in want.items())
    assert sorted(map(tuple, dfs.collect())) == sorted(Counter(w for _, w in want).items())
    assert {(r["doc_id"], r["word"]): r["c"] for r in keywords.term_counts(files, words=some).collect()} == {k: c for k, c in want.items() if k[1] in some}


@pytest.mark.parametrize("shared", [100, 0])
def test_all_mentions(spark, monkeypatch, shared):
    """A word's mentions in all of its files, also where files share a doc_id, a few or too many; texts of other files don't travel."""
    monkeypatch.setattr(keywords, "SHARED", shared)
    rows = [(k, f"first\n  says Common{'abc'[k % 3]} and\r\nrare{chr(97 + k // 26)}{chr(97 + k % 26)}x often") for k in range(300)]
    files = spark.createDataFrame(rows, "doc_id long, text string")
    single = keywords.all_mentions(files, 300, True)
    want = {(f"common{'abc'[k % 3]}", k, 1, f"says Common{'abc'[k % 3]} and") for k, _ in rows}
    got = [tuple(r) for r in single.collect()]
    assert len(got) == 300 and set(got) == want
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    files = spark.createDataFrame([*rows, (5, "COMMONA"), (5, None), (None, "commona")], "doc_id long, text string")
    got = [tuple(r) for r in keywords.all_mentions(files, 303).collect()]
    assert sorted(got) == sorted([*want, ("commona", 5, 0, "COMMONA")])
