import hashlib
import re
from collections import Counter

import pytest

from loomgraph.llm import substrings as s
from tests.llm.common import clashing, documents, none, odd, rows


def brute(docs, window=35):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    n = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if n[tuple(w[k : k + window])] > 1 for j in range(window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(s.op9_substring_dedup(spark, sf))
    assert got == brute(documents(spark, sf))
    assert sum(r[2] for r in got)


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_small_windows_and_hot_minimisers(spark, hot):
    import random

    rng = random.Random(hot)
    common = " ".join(rng.choice("abcdefgh") for _ in range(30))
    docs = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) + (" " + common) * rng.randint(0, 2)) for k in range(60)]
    docs += [docs[3], docs[4], (7, "other text")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = s.remove_repeats(df, 7, 2, hot)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()), key=repr) == brute(docs, 7)


def test_odd_rows(spark):
    for docs in (odd(spark), clashing(spark, ["th", "marks", "packed", "pos"])):
        got = s.remove_repeats(docs, 5, 2, 4)
        want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()), key=repr) == want
    assert s.remove_repeats(none(spark)).count() == 0
