import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import lm_scoring as m
from tests.llm.common import clashing, documents, none, odd


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))


def brute_base(docs, held):
    c = Counter()
    for i, t in docs:
        if not held(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in docs:
        w = [*words(t), None]
        out[i] = held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
    return out


def lattice():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aba", *(f"<0x{b:02X}>" for b in range(256))]
    p = np.array([3, 2, 2, 4, 1, 5, 2, *[0.1] * 256, 3.0])
    return pieces, m.Lattice(pieces, list(range(7, 263)), np.log(p / p.sum()))


def segmentations(text, pieces, logp):
    """(probability, pieces) of each way to spell the text."""
    if not text:
        yield 1.0, []
        return
    for k, p in enumerate(pieces[:7]):
        if text.startswith(p):
            for q, rest in segmentations(text[len(p) :], pieces, logp):
                yield math.exp(logp[k]) * q, [k, *rest]
    spelled = [7 + b for b in text[0].encode()]
    for q, rest in segmentations(text[1:], pieces, logp):
        yield math.exp(sum(logp[k] for k in spelled)) * q, [*spelled, *rest]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=6), min_size=1, max_size=5))
def test_forward_and_expectation_against_all_segmentations(texts):
    pieces, lat = lattice()
    weights = np.arange(1.0, len(texts) + 1)
    got, expected = lat.marginals([t.encode() for t in texts], weights)
    want = np.zeros(len(lat.logp))
    for k, t in enumerate(texts):
        all_ways = list(segmentations(m.MARK + t, pieces, lat.logp))
        total = sum(p for p, _ in all_ways)
        assert math.isclose(got[k], math.log(total), rel_tol=1e-9)
        for p, ids in all_ways:
            for i in ids:
                want[i] += weights[k] * p / total
    assert np.allclose(expected, want)


def test_query(spark, sf):
    docs = documents(spark, sf)
    want = brute_base(docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    rows = m.op10_lm_scoring(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4]
        assert math.isclose(r["base_score"], want[r["doc_id"]][4], rel_tol=1e-9)
    # training raises the probability of held-out texts
    plain = m.vocabulary(m.default_path())
    held = [(r["doc_id"], r["score"]) for r in rows if r["held_out"]]
    text = dict(docs)
    before = sum(plain.marginals(words_b)[0].sum() / math.log(10) for i, _ in held if (words_b := m.words_of(text[i])))
    assert held and all(r["score"] < 0 for r in rows) and sum(s for _, s in held) > before


@pytest.mark.parametrize("frequent", [1, 10, 65536])
def test_odd_rows(spark, frequent):
    from pyspark.sql import functions as F

    for docs in (odd(spark), clashing(spark, ["train", "th", "word", "key"])):
        train = F.col("doc_id") != 3
        rows = m.score(docs, train, frequent=frequent).collect()
        data = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = brute_base(data, lambda i: i == 3)
        assert sorted(r["doc_id"] or 0 for r in rows) == sorted(i or 0 for i, _ in data)
        for r in rows:
            assert (not r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4] and math.isclose(r["base_score"], want[r["doc_id"]][4], rel_tol=1e-9)
    assert m.score(none(spark), F.lit(True)).count() == 0
    assert all(r["base_score"] == 0 and math.isfinite(r["score"]) for r in m.score(odd(spark), F.lit(False)).collect())


def test_long_words(monkeypatch):
    """A word of a million characters takes seconds, and stretches give what single steps give."""
    import random
    import time

    r = random.Random(3)
    lattice = m.vocabulary(m.default_path())
    words = ["".join(r.choice("etaoinshrdlu▁") for _ in range(n)).encode() for n in (1000, 1001, 1500, 4097)] + ["é中\U0001f600x".encode() * 600]
    weights = np.arange(1.0, len(words) + 1)
    got, expected = lattice.marginals(words, weights)
    monkeypatch.setattr(m, "LONG_CHARS", 10**9)
    want, plain = lattice.marginals(words, weights)
    assert np.allclose(got, want, rtol=0, atol=1e-6) and np.allclose(expected, plain, rtol=1e-8, atol=1e-5)
    monkeypatch.undo()
    began = time.perf_counter()
    lp, expected = lattice.marginals(["".join(r.choice("etaoin") for _ in range(10**6)).encode()], np.ones(1))
    assert time.perf_counter() - began < 60 and np.isfinite(lp[0])
    sizes = [len(p) for p in lattice_pieces(lattice)]
    assert abs(sum(n * c for n, c in zip(sizes, expected)) - (10**6 + 1)) < 5  # the expected pieces, bytes among them, cover the word and its mark


def lattice_pieces(lattice):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=m.default_path())
    used = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    return ["b" if sp.is_byte(i) else sp.id_to_piece(i) for i in used]
