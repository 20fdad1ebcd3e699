from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing as m
from tests.llm.common import clashing, documents, none, odd, rows


def words(t):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fair(sizes, share=1.5, repeats=2, weights=(5, 2, 1)):
    """Targets by sharing again and again, from sizes in the sources' order."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), {}
    while open_:
        unit = left / sum(weights[k % 3] for k in open_)
        full = {k for k in open_ if unit * weights[k % 3] >= repeats * sizes[k]}
        if not full:
            return [out.get(k, unit * weights[k % 3]) for k in range(len(sizes))]
        for k in full:
            out[k] = repeats * sizes[k]
            left -= out[k]
        open_ -= full
    return [out[k] for k in range(len(sizes))]


def by_source(pairs):
    size = defaultdict(int)
    for source, n in pairs:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    return {s: (size[s], t) for s, t in zip(order, fair([size[s] for s in order]))}


def test_query(spark, sf):
    got = m.op13_source_mixing(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    data = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    want = by_source((r["source"], words(r["text"])) for r in data)
    source, size = {r["doc_id"]: r["source"] for r in data}, {r["doc_id"]: words(r["text"]) for r in data}
    taken = Counter()
    got = got.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == want[s][0] and r["target"] == pytest.approx(want[s][1])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - t) <= 0.5 for s, (_, t) in want.items())
    assert rows(m.op13_source_mixing(spark, sf)) == sorted(map(tuple, got), key=repr)  # another run


def test_schedule(spark):
    """Slots are a permutation with the right ranks, every prefix of them follows the shares, and each document's words are
    taken from its start on, as often as its source goes round."""
    data = [(k, " ".join(["w"] * (1 + k * 37 % 50)), "abcd"[min(3, k % 9)]) for k in range(400)] + [(400 + k, "w " * 3, None) for k in range(2)]
    mix = m.plan(spark.createDataFrame(data, "doc_id long, text string, source string"), block_words=16)
    own = {r["sid"]: r.asDict() for r in mix.sources.collect()}
    made = [r for r in m.slots(mix.sources, mix.bits).collect()]
    assert sum(r["slots"] for r in own.values()) == len(made) and len({(r["slot"], r["sid"]) for r in made}) == len(made)
    for sid in own:
        mine = sorted((r["slot"], r["rank"]) for r in made if r["sid"] == sid)
        assert [k for _, k in mine] == list(range(own[sid]["slots"]))
    total = sum(r["taken"] for r in own.values())
    order = sorted((r["slot"], r["sid"]) for r in made)
    seen = Counter()
    for n, (_, sid) in enumerate(order, 1):
        seen[sid] += 1
        assert all(abs(seen[s] - n * own[s]["taken"] / total) <= mix.bits for s in own)
    pieces = m.schedule(mix).orderBy("slot", "sid", "doc_id").collect()
    rank = {(r["sid"], r["slot"]): r["rank"] for r in made}
    block = Counter()
    spans = defaultdict(list)
    for r in pieces:
        block[r["sid"], rank[r["sid"], r["slot"]]] += r["words"]
        spans[r["doc_id"]].append((rank[r["sid"], r["slot"]], r["start"], r["words"]))
    for sid, r in own.items():
        mine = [n for (s, _), n in block.items() if s == sid]
        assert sum(mine) == r["taken"] and (not mine or max(mine) - min(mine) <= 1)  # blocks of equally many words
    size = {i: words(t) for i, t, _ in data}
    for i, parts in spans.items():
        covered = Counter(w for _, a, n in parts for w in range(a, a + n))
        assert max(covered.values()) <= 2 and set(covered) <= set(range(size[i]))
        assert sorted(covered.elements()) == sorted(list(range(size[i])) * (sum(covered.values()) // size[i]) + list(range(sum(covered.values()) % size[i])))


def test_one_source_and_tiny_ones(spark):
    got = m.taken_words(m.plan(spark.createDataFrame([(1, "a b c", "s"), (2, "d", "s")], "doc_id long, text string, source string"))).collect()
    assert sum(r["taken"] for r in got) == 6 and {r["target"] for r in got} == {6.0}
    tiny = [(0, "x", "a"), (1, "y", "b")] + [(2 + k, "w " * 5000, "c") for k in range(60)]
    got = rows(m.taken_words(m.plan(spark.createDataFrame(tiny, "doc_id long, text string, source string"))), "doc_id", "taken")
    assert got[0][1] == 2 and [t for i, t in got if i == 1] == [2]  # less than a slot each, yet taken twice


def test_odd_rows(spark):
    for docs in (odd(spark), clashing(spark, ["sid", "bucket", "rn", "size", "taken", "target", "slots", "h", "th"])):
        got = m.taken_words(m.plan(docs)).collect()
        want = sorted((r["doc_id"] is None, r["doc_id"] or 0, words(r["text"])) for r in docs.collect())
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == want
        assert all(r["taken"] <= 2 * r["size"] for r in got)
        aims = by_source((r["source"], words(r["text"])) for r in docs.collect())
        assert {(r["source"], r["source_size"], round(r["target"], 6)) for r in got} == {(s, n, round(t, 6)) for s, (n, t) in aims.items()}
    assert m.taken_words(m.plan(none(spark))).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert rows(m.taken_words(m.plan(blank)), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_long_document(spark):
    docs = spark.createDataFrame([(1, "w " * 1_000_000, "a"), (2, "v", "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in m.taken_words(m.plan(docs)).collect()}
    assert got[1]["taken"] == round(got[1]["target"]) and got[2]["taken"] == 2


def test_no_python_in_the_plan(spark, sf):
    text = m.op13_source_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not any(w in text for w in ("Python", "Arrow", "Pandas"))
