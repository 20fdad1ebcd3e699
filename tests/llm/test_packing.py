import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import packing as p
from loomgraph.llm._tokens import Encoder, default_path
from tests.llm.common import clashing, documents, none, odd


def brute_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def check(got, docs, size):
    ids = brute_ids([t for _, t in docs])
    want = Counter((i, k // size, k, len(x[k : k + size]), zlib.crc32(np.array(x[k : k + size], "<u4").tobytes())) for (i, _), x in zip(docs, ids) for k in range(0, len(x), size))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= size
    total = sum(map(len, ids))
    return len(bins), -(-total // size)


def test_query(spark, sf):
    got = p.op6_best_fit_packing(spark, sf).collect()
    bins, least = check(got, documents(spark, sf), 4096)
    assert bins <= least + 1


def test_odd_rows(spark):
    for docs in (odd(spark), clashing(spark, ["piece", "length", "sequence_id"])):
        got = p.pack_documents(docs, size=64).collect()
        check(got, [(r["doc_id"], r["text"]) for r in docs.collect()], 64)
    assert p.pack_documents(none(spark)).count() == 0


def test_sequences(spark):
    docs = odd(spark)
    made = p.sequences(p.pack(p.pieces(docs, size=64), 64)).collect()
    have = Counter(i for x in brute_ids([r["text"] for r in docs.collect()]) for i in x)
    assert Counter(i for r in made for i in np.frombuffer(r["ids"], "<u4").tolist()) == have and all(len(r["ids"]) <= 256 for r in made)


def best(counts, room):
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= room}
    return max(reach)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 60))
def test_fullest_is_fullest(counts, room):
    got = p.fullest(counts, sorted(counts, reverse=True), room)
    assert sum(got) == best(counts, room) and all(c <= counts[n] for n, c in Counter(got).items())


def test_plan_places_every_piece_once():
    rng = random.Random(5)
    hist = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(40)}
    used = defaultdict(list)
    fill = defaultdict(list)
    for n, first, ranks, per, bin0, offset in p.plan(hist, 64):
        used[n] += range(first, first + ranks)
        for k in range(ranks):
            fill[bin0 + k // per].append((offset + k % per * n, n))
    assert {n: sorted(r) for n, r in used.items()} == {n: list(range(c)) for n, c in hist.items()}
    assert all(sum(n for _, n in f) <= 64 for f in fill.values())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aZ'sdlé1²_-.,<|> \n\t ß", max_size=60)))
def test_word_by_word_encoding_is_exact(text):
    global ENCODER
    got = np.frombuffer(ENCODER.encode(text), "<u4").tolist()
    assert got == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


ENCODER = Encoder(default_path())
