import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from loomgraph.llm import divergence as d
from tests.llm.common import clashing, none, odd, rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {k: k + 32 for k in range(65, 91)}


def brute(docs, min_docs=3, top=200):
    """docs: (text, lang, source)."""
    unit = 10**9
    count, df, sources = defaultdict(Counter), Counter(), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        words = Counter(t.translate(SMALL) for t in TERM.findall(text or ""))
        count[lang, source].update(words)
        df.update((lang, t) for t in words)
    out = []
    for lang, own in sources.items():
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= min_docs)
        total = {s: sum(count[lang, s][t] for t in kept) for s in own}
        share = {s: {t: 1 + unit * (count[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in own}
        whole = {t: 1 + unit * (sum(count[lang, s][t] for s in own) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        far = lambda p, q: (p - q) ** 2 // q
        for s in own:
            pair = [(x, sum(far(share[s][t], share[x][t]) for t in kept)) for x in own if x != s]
            term = [(t, far(share[s][t], whole[t])) for t in kept if count[lang, s][t] and share[s][t] > whole[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audited(docs, **more):
    return sorted(map(tuple, d.audit(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect()))


def table(spark, data):
    return spark.createDataFrame(data, "text string, lang string, source string")


def test_query(spark, sf):
    got = d.op11_source_divergence(spark, sf)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({d.SQL})").fetchall())
    assert sorted(map(tuple, got.collect())) == want
    assert want == brute([(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_against_brute_force(spark):
    words = ["a", "B", "b", "é", "É", "x1y", "ẞ", "ſ", "zz"]
    data = [(" ".join(words[(k * j + j) % (3 + k % 7)] for j in range(k % 11)), ["en", "de", None][k % 3], [None, "s", "t", "", "Ü"][k % 5]) for k in range(120)]
    data += [("rare words only here", "lone", "one"), (None, "lone", "two"), ("", "alone", "x")]
    for min_docs, top in ((3, 200), (1, 2)):
        assert audited(table(spark, data), min_docs=min_docs, top=top) == brute(data, min_docs, top)


def test_small_chunks(spark, monkeypatch):
    """Where tasks flush often and chunks end within a batch, nothing is lost or counted twice."""
    data = [(f"common w{k % 40} v{k % 17} u{k}", "en" if k % 3 else "de", f"s{k % 6}") for k in range(300)]
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _, _ in data], "lang": [x for _, x, _ in data], "source": [s for _, _, s in data]})
    monkeypatch.setattr(d, "FLUSH_ROWS", 50)
    monkeypatch.setattr(d, "CHUNK_BYTES", 300)
    part = pa.Table.from_batches(d.count_documents([batch]))
    assert part.num_rows > len({(x, t) for text, x, _ in data for t in TERM.findall(text)})
    part = part.sort_by([("lang", "ascending"), ("term", "ascending")])
    chunks = list(d.whole_terms(part.to_batches(max_chunksize=7), 20))
    assert sum(c.num_rows for c in chunks) == part.num_rows and len(chunks) > 5
    seen = [{*zip(c["lang"].to_pylist(), c["term"].to_pylist())} for c in chunks]
    assert sum(map(len, seen)) == len(set().union(*seen))
    got = pa.Table.from_batches(d.shard_counts(part.to_batches(max_chunksize=7), 3)).to_pylist()
    want = Counter((x, t, s) for text, x, s in data for t in TERM.findall(text))
    df = Counter((x, t) for text, x, _ in data for t in set(TERM.findall(text)))
    assert {(r["lang"], r["term"], r["source"]): r["n"] for r in got if r["term"]} == {k: n for k, n in want.items() if df[k[:2]] >= 3}
    assert sum(r["first"] for r in got) == sum(n >= 3 for n in df.values())


def test_hot_and_extreme(spark):
    """A term that stands in every document, one source with nearly all of them, and shares at both ends of the range."""
    data = [("the " * 500, "en", "hot")] * 400 + [("the end", "en", "cold")] * 3 + [("z", "en", "z")] * 3 + [("z", "one", "z")] * 3
    assert audited(table(spark, data)) == brute(data)


def test_odd_rows(spark):
    for docs in (odd(spark), clashing(spark, ["term", "part", "item", "value", "rank", "n", "docs", "sources", "counts"])):
        assert audited(docs, min_docs=1) == brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 1)
    assert audited(none(spark)) == []
    assert rows(d.audit(table(spark, [(None, None, None)] * 2))) == []


@pytest.mark.parametrize("text", ["x" * 1_000_000, "ab " * 400_000, "é\x00" * 300_000])
def test_long_texts(spark, text):
    data = [(text, "en", s) for s in "aab"]
    assert audited(table(spark, data)) == brute(data)
