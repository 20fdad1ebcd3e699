import random
from collections import defaultdict

import numpy as np
import pytest

from loomgraph.llm import _near
from loomgraph.llm import ngram_join as j
from tests.llm.common import clashing, documents, none, odd


def grams(t):
    w = (t or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs, s=0.8):
    """(doc_id, class_id, n_links, n_text_links) of each row."""
    sets = [grams(t) for _, t in docs]
    by = defaultdict(list)
    for k, g in enumerate(sets):
        for x in g:
            by[x].append(k)
    link = defaultdict(set)
    for k, g in enumerate(sets):
        shared = defaultdict(int)
        for x in g:
            for o in by[x]:
                shared[o] += 1
        link[k] = {o for o, n in shared.items() if o != k and n >= s * (len(g) + len(sets[o]) - n) - 1e-12}
    seen, out = {}, []
    for k in range(len(docs)):
        if k not in seen:
            todo, group = [k], {k}
            while todo:
                for o in link[todo.pop()] - group:
                    group.add(o)
                    todo.append(o)
            ids = [docs[o][0] for o in group if docs[o][0] is not None]
            seen |= dict.fromkeys(group, min(ids) if ids else None)
        out.append((docs[k][0], seen[k], len(link[k]), len({sets[o] for o in link[k]} - {sets[k]})))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "class_id", "n_links", "n_text_links").collect()), key=repr)


def near_docs(rng, n):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 120))] for _ in range(6)]
    out = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        out.append((k, " ".join(w)))
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert got(j.op4_ngram_jaccard_join(spark, sf)) == brute(documents(spark, sf))


@pytest.mark.parametrize("cells", [{}, {"block_members": 7}, {"block_elements": 900}])
def test_near_copies_in_blocks(spark, cells):
    docs = near_docs(random.Random(3), 150)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert got(j.ngram_classes(df, **cells)) == want
    kept = sorted(r["doc_id"] for r in j.keep_one(df, **cells).collect())
    assert kept == sorted({r[1] for r in want})


def test_odd_rows(spark):
    docs = odd(spark)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(j.ngram_classes(docs)) == want
    df = clashing(spark, ["th", "cid", "n", "bands", "class_id", "alone", "_key", "_ALONE", "_nth", "_kept"])
    assert got(j.ngram_classes(df)) == want
    kept = j.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert j.ngram_classes(none(spark)).count() == 0 and j.keep_one(none(spark)).count() == 0


def test_unlike_groups_of_one_id(spark):
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    docs = spark.createDataFrame([(None, one), (None, one), (None, two), (7, three), (7, four), (7, four), (8, three)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in j.keep_one(docs).collect()), key=repr) == sorted([(None, one), (None, two), (7, three), (7, four)], key=repr)
    roots = {}
    for r in j.ngram_classes(docs).collect():
        roots.setdefault(r["root"], []).append(r["class_id"])
    assert sorted(roots.values(), key=repr) == [[7, 7], [7, 7], [None, None], [None]]


def test_components(spark):
    from loomgraph.llm._base import Scratch
    from loomgraph.llm.components import components

    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(200, 201 + k) for k in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (-3, 900)]
    root = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["id"]: r["root"] for r in found.collect()} == {k: v for k, v in root.items() if k in linked}


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8**4) ** _near.choose_bands(0.8, 0.999, 4) >= 0.999
    rng, hit = np.random.default_rng(0), 0
    bands = _near.choose_bands(0.8, 0.999, 4)
    for _ in range(300):
        x = rng.integers(0, 1 << 62, 100).astype(np.uint64)
        a, b = x[:90], x[10:]  # similarity 0.8
        sig = j.minhashes(np.concatenate([a, b]), np.array([0, 90, 180]), bands * 4)
        h = _near.band_hashes(sig, bands, 4)
        hit += bool((h[0] == h[1]).any())
    assert hit >= 296
