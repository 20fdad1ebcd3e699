import functools
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import alignment as al
from tests.llm.common import clashing, documents, none, odd, rows

COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@functools.cache
def _pair():
    return al.Pair(*al.default_paths())


@pytest.fixture(scope="module")
def pair():
    return _pair()


def tokens(pair, text):
    """(A ids and ends, B ids and ends) of space and the whole text at once, token by token."""
    whole = (" " + text).encode()
    out = []
    for ids, spelled in ((pair.a.encode(" " + text, add_special_tokens=False).ids, pair.bytes_a), (pair.b.encode(text), pair.bytes_b)):
        if b"".join(spelled[i] for i in ids) != whole:
            return None
        ends, at = [], 0
        for i in ids:
            at += len(spelled[i])
            ends.append(at)
        out.append((list(ids), ends))
    return out


def groups_of(pair, text):
    """A document's groups and links, by walking over its ends."""
    if not text or (both := tokens(pair, text)) is None:
        return [], []
    (ids_a, ends_a), (ids_b, ends_b) = both
    shared = sorted(set(ends_a) & set(ends_b))
    groups, links, i, j = [], [], 0, 0
    for end in shared:
        a, b = [], []
        while i < len(ids_a) and ends_a[i] <= end:
            a.append(ids_a[i])
            i += 1
        while j < len(ids_b) and ends_b[j] <= end:
            b.append(ids_b[j])
            j += 1
        groups.append((a, b))
        links.append((a[-1], b[-1]))
    return groups, links


def brute(pair, docs):
    made = [(i, *groups_of(pair, t)) for i, t in docs]
    count = Counter(x for _, _, links in made for x in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, groups, links in made:
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out, key=repr)


def test_query(spark, sf, pair):
    got = al.op12_token_alignment(spark, sf)
    assert got.dtypes == [(c, "string" if c == "groups_sha256" else "bigint") for c in COLS]
    assert rows(got, *COLS) == brute(pair, documents(spark, sf))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=12))
def test_elementary(a, b):
    """Intervals tile the bytes, and each lies in the tokens given for it."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    n = max(ends_a[-1], ends_b[-1])
    ends_a, ends_b = (np.append(e, n) if e[-1] < n else e for e in (ends_a, ends_b))
    ends, of_a, of_b, both = al.elementary(ends_a, ends_b)
    starts = np.append(0, ends[:-1])
    for owners, own in ((of_a, ends_a), (of_b, ends_b)):
        first = np.append(0, own[:-1])
        assert (first[owners] <= starts).all() and (ends <= own[owners]).all()
    assert set(ends[both].tolist()) == set(ends_a.tolist()) & set(ends_b.tolist())
    overlaps = sum(max(p, r) < min(q, s) for p, q in zip(np.append(0, ends_a[:-1]), ends_a) for r, s in zip(np.append(0, ends_b[:-1]), ends_b))
    assert len(ends) == overlaps


WILD = st.lists(st.sampled_from([*"abT's9 \n\t\r.,<|>é\u3000\xa0\x1c\x85▁\U0001f600中", "<|endoftext|>", "<s>", "<0x41>", "  ", "the", " of"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(WILD, max_size=6))
def test_units(texts):
    """Texts put together from units have the tokens, groups and links of whole texts."""
    import pyarrow as pa

    pair = _pair()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    made = pa.Table.from_batches(al.align_batches([batch], al.default_paths(), True)).to_pylist() if texts else []
    assert len(made) == len(texts) + bool(texts)
    for text, got in zip(texts, made):
        groups, links = groups_of(pair, text)
        assert got["groups"] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups), text
        assert np.frombuffer(got["links"], np.uint32).tolist() == [a * pair.n_b + b for a, b in links]
    count = Counter(a * pair.n_b + b for t in texts for a, b in groups_of(pair, t)[1])
    if texts:
        assert dict(zip(np.frombuffer(made[-1]["links"], np.uint32).tolist(), np.frombuffer(made[-1]["counts"], np.int64).tolist())) == count


def test_small_cache(spark, sf, pair, monkeypatch):
    """Units that are forgotten again and again change nothing."""
    import pyarrow as pa

    docs = documents(spark, sf)[:60]
    monkeypatch.setattr(al, "CACHE_UNITS", 100)
    monkeypatch.setattr(al, "CACHE_CHARS", 8)
    monkeypatch.setattr(al, "CALL_CHARS", 50)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs[k : k + 7]], "text": [t for _, t in docs[k : k + 7]]}) for k in range(0, len(docs), 7)]
    made = pa.Table.from_batches(al.align_batches(batches, al.default_paths(), False)).to_pylist()
    assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) for r in made[:-1]] == sorted((r[:4] + (r[7],) for r in brute(pair, docs)), key=lambda r: [i for i, _ in docs].index(r[0]))
    count = Counter(a * pair.n_b + b for _, t in docs for a, b in groups_of(pair, t)[1])
    assert dict(zip(np.frombuffer(made[-1]["links"], np.uint32).tolist(), np.frombuffer(made[-1]["counts"], np.int64).tolist())) == count


def test_bound(pair):
    """No more pairs can be linked than the vocabularies have common endings."""
    def ends(these, those):
        known = Counter(those)
        return sum(known[x[k:]] for x in these for k in range(len(x)))

    known = Counter(pair.bytes_b)
    whole = sum(known[x] for x in pair.bytes_a if x)
    assert ends(pair.bytes_a, pair.bytes_b) + ends(pair.bytes_b, pair.bytes_a) - whole < 600_000


def test_odd_rows(spark, pair):
    for docs in (odd(spark), clashing(spark, ["n_a", "links", "counts", "groups", "n_groups"])):
        assert rows(al.align(docs), *COLS) == brute(pair, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert al.align(none(spark)).count() == 0


@pytest.mark.parametrize("text", ["x" * 1_000_000, "ab?" * 330_000, "é" * 500_000, " " * 300_000, "to be or \n" * 100_000])
def test_long_texts(spark, pair, text):
    docs = [(1, text), (2, "short one"), (3, "a▁b")]
    assert rows(al.align(spark.createDataFrame(docs, "doc_id long, text string")), *COLS) == brute(pair, docs)
