import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import decontaminate as d
from tests.llm.common import clashing, documents, none, odd, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = brute_words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w = brute_words(t)
        hit, who = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    who |= x
        out.append((i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(d.op7_decontamination(spark, sf))
    assert got == brute(documents(spark, sf), items)
    assert any(r[-1] for r in got)


words = st.lists(st.sampled_from("abc"), max_size=30).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=4), words, st.integers(1, 6))
def test_automaton(items, text, window):
    auto = d.SuffixAutomaton([(str(k), d.words_of(t)) for k, t in enumerate(items)], window)
    got, who = auto.occurrences(d.words_of(text))
    want = brute([(0, text)], list(enumerate(items)), window)[0]
    assert (sum(b - a for a, b in got), len(who)) == (want[2], want[3])
    assert got == d.merged(got)


def test_odd_rows_and_several_automata(spark):
    bench = spark.createDataFrame([(1, "same words the same"), (2, None), (None, "x"), (3, ""), (4, "no id"), (5, "word " * 20), (4, "no id")], "item_id long, text string")
    items = [(1, "same words the same"), (4, "no id"), (5, "word " * 20)]
    for docs in (odd(spark), clashing(spark, ["spans", "items", "n_words", "n_hit"])):
        want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)
        assert rows(d.digest(d.find_spans(docs, bench))) == want
        assert rows(d.digest(d.find_spans(docs, bench, most_words=3))) == want
    kept = d.decontaminate(clashing(spark, ["spans", "items"]), bench)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "items"] and kept.count() == 5
    assert d.digest(d.find_spans(none(spark), bench)).count() == 0
    assert not any(r["contaminated"] for r in d.digest(d.find_spans(odd(spark), bench.limit(0))).collect())


def test_clashing_columns_keep_their_values(spark):
    df = clashing(spark, ["n_words", "spans", "items", "n_hit", "n_items", "contaminated"])
    got = d.decontaminate(df, spark.createDataFrame([], "item_id string, text string"))
    assert got.columns == df.columns and rows(got) == rows(df)


def test_cut(spark):
    assert d.cut("One, two. THREE four five", [[1, 3]], 2) == "One,  four five"
    assert d.cut("One, two", [[0, 1]], 2) == "One, two"


def test_a_large_benchmark_in_blocks(spark):
    """Long items are cut into pieces that lose no window; many automata, built in tasks and scanned one at a time, find what one does."""
    import random

    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([60_000, 30_000, *[40] * 1500, *[5] * 50])]
    long = items[0][1].split()
    docs = [(k, " ".join(rng.choices(vocabulary, k=50) + long[a : a + n])) for k, (a, n) in enumerate([(19_990, 13), (19_995, 30), (0, 12), (59_980, 20), (30_000, 2000), (39_988, 13), (19_988, 13)])] + [(100 + k, items[k][1]) for k in (1, 5, 1551)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    many = d.find_spans(df, bench, most_words=30_000)
    cut = d.pieces(bench, 13, 20_000).collect()
    assert max(r["n"] for r in cut) <= 20_012 and sum(r["item"] == "0" for r in cut) == 3
    want = brute(docs, items)
    assert sum(r[2] > 0 for r in want) >= 8
    assert rows(d.digest(many)) == want == rows(d.digest(d.find_spans(df, bench, most_words=10**9)))
