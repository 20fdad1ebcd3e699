from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import quality as q
from tests.llm.common import clashing, documents, none, odd, rows


def brute(t):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(t or "")
    lines = [x for x in (t or "").split("\n") if word.search(x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab# \n\té\x0b ", max_size=40), max_size=5))
def test_measures(texts):
    got = q.measure_column(pa.array(texts, pa.string()))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(got[m][k]) for m in names) for k in range(len(texts))] == [brute(t) for t in texts]


def test_query(spark, sf):
    want = sorted(((i, *(b := brute(t)), b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in documents(spark, sf)), key=repr)
    assert rows(q.op8_quality_rules(spark, sf), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want


def test_hosts(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "x"
    data = [(k, good if k % 10 else bad, "good") for k in range(100)] + [(100 + k, bad if k % 10 else good, "bad") for k in range(100)] + [(300, good, "one"), (301, bad, "two"), (302, good, None)]
    got = {r["doc_id"]: r for r in q.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(got[k]["kept"] == bool(k % 10) for k in range(100)) and not any(got[100 + k]["kept"] for k in range(100))
    assert got[300]["kept"] and got[302]["kept"] and not got[301]["kept"] and got[302]["host_kept"]
    rates = {r["host"]: r for r in q.host_verdicts(q.measure(spark.createDataFrame(data, "doc_id long, text string, source string")), q.default_rules()).collect()}
    assert 0.1 < rates["good"]["rate_base"] < 0.12 and 0 < rates["one"]["rate_base"] < 0.6  # one document weighs little


def test_odd_rows(spark):
    for docs in (odd(spark), clashing(spark, ["host", "kept", "n_words"])):
        assert sorted((r["doc_id"] or 0, r["n_words"]) for r in q.judge(docs).collect()) == sorted((r["doc_id"] or 0, brute(r["text"])[0]) for r in docs.collect())
    assert q.judge(none(spark)).count() == 0
