import random

import numpy as np
import pytest

from loomgraph.llm import toxicity as t
from tests.llm.common import clashing, none, odd
from tests.llm.common import rows as rows_of


def brute_kernel(a, b, decay=t.DECAY, reach=t.REACH):
    def feature(w):
        w, out = f"\x02{w}\x03", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + reach)):
                    x = w[i] + w[j] + w[k]
                    out[x] = out.get(x, 0) + decay ** (k - i + 1)
        return out

    fa, fb = feature(a), feature(b)
    product = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    return product(fa, fb) / (product(fa, fa) * product(fb, fb)) ** 0.5


def test_kernel():
    windows = ["abcd", "acbd", "aabbcc", "dcba", "abxcd", "ab", "a", "banana", "слово", "слxово", "\U00010330\U00010331b"]
    landmarks = t.Landmarks(windows[:8])
    got = landmarks.kernel(windows)
    for i, a in enumerate(windows):
        for j, b in enumerate(windows[:8]):
            assert abs(got[i, j] - brute_kernel(a, b)) < 1e-3  # columns are hashed
    x = landmarks.features(windows)
    assert np.allclose(x[:8, :-1] @ x[:8, :-1].T, got[:8], atol=1e-3)  # Nyström is exact on its landmarks
    w = np.linspace(-1, 1, x.shape[1])
    assert np.allclose(landmarks.machine(w).decide(windows), x @ w, atol=1e-3)


def test_windows():
    assert t.windows_of("s.c-u_m!") == ["scum"] and t.windows_of("12,5%") == [] and t.windows_of("Der-Tag") == ["dertag", "der", "tag"]
    assert max(map(len, t.windows_of("x" * 1000 + "idiot"))) == t.PIECE and any(w.endswith("idiot") for w in t.windows_of("x" * 1000 + "idiot"))
    assert t.tokens_of("so b a d it")[-1] == "bad"


def made(rng, n):
    good = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = ["wortless", "scumbag", "grobble"]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(20, 80))]
        toxic = k % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((k, " ".join(words) + "."))
        labels.append((k, int(toxic)))
    return docs, labels


def test_gaps_and_inserted_characters(spark):
    docs, labels = made(random.Random(1), 400)
    model = t.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), ~t.held_out())
    clean = "some tame near rest more"
    tests = [(k, f"{clean} {w} {clean}") for k, w in enumerate(["wortless", "scumbag", "s.c.u.m.b.a.g", "s c u m b a g", "scum_bag", "scuxmbag", "Grobble!", "", "tames", "nearest"])]
    got = {r["doc_id"]: r["score"] for r in t.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert all(got[k] > 0.5 for k in range(7)) and all(got[k] < 0.5 for k in range(7, 10))


def test_held_out_accuracy(spark):
    """Recall and false positives on texts that training doesn't see, by language, and with gapped and inserted letters.

    Labels in junk texts that hold no insult can't be found: some 6% of the toxic ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = t.train(docs, labels, ~t.held_out())
    seen = docs.join(labels, "doc_id").where(t.held_out()).select("doc_id", "lang", "toxic", "text")
    toxic = {r["doc_id"]: (r["lang"], r["toxic"], r["text"]) for r in seen.collect()}
    score = {r["doc_id"]: r["score"] for r in t.score(seen, model).collect()}
    assert all(0 <= v <= 1 for v in score.values())
    for kind in (1, 0):
        rate = lambda lang: np.mean([score[i] >= 0.5 for i, (x, k, _) in toxic.items() if k == kind and lang in (x, "")])  # noqa: B023, E731
        assert rate("") >= 0.9 if kind else all(rate(lang) <= 0.05 for lang in ("en", "de", "fr", "es"))
        assert not kind or all(rate(lang) >= 0.85 for lang in ("en", "de", "fr", "es"))
    insults = ["idiot", "worthless", "pathetic", "disgusting", "stupid"]
    clean = [x for lang, k, x in toxic.values() if lang == "en" and not k and 20 < len(x.split()) < 120][:40]
    for change in (lambda w: ".".join(w), lambda w: w[:2] + "-" + w[2:], lambda w: " ".join(w), lambda w: w[:3] + "x" + w[3:], lambda w: w[:2] + "*q" + w[2:]):
        rows = [(k, f"{change(insults[k % 5])} {x} {change(insults[(k + 1) % 5])} {change(insults[(k + 2) % 5])}") for k, x in enumerate(clean)]
        got = [r["score"] for r in t.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
        assert np.mean(np.array(got) >= 0.5) >= 0.9


def test_scores_follow_the_share_of_all_labels(spark):
    rng = random.Random(4)
    docs, labels = made(rng, 800)
    docs = [(k, x if rng.random() < 0.5 else x.replace("wortless", "rest").replace("scumbag", "tame").replace("grobble", "near")) for k, x in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = t.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), ~t.held_out(), most=100)
    assert 0.15 < np.mean([r["score"] for r in t.score(df, model).collect()]) < 0.35  # a quarter is toxic, half of the sample


def test_few_labels(spark, sf):
    """Ten toxic texts: insults that two of them share are found."""
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in t.op2_toxicity(spark, sf).collect() if r["doc_id"] in toxic and lang[r["doc_id"]] == "en"]
    mean = [np.mean([r["score"] for r in rows if toxic[r["doc_id"]] == k]) for k in (0, 1)]
    assert mean[1] > 0.5 > 0.2 > mean[0]


def test_other_script(spark):
    """Letters of any script count, those beyond U+FFFF too."""
    turn = {c: chr(0x10330 + k) for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    docs, labels = made(random.Random(3), 300)
    docs = [(k, "".join(turn.get(c, c) for c in x)) for k, x in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in t.score(df, t.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), ~t.held_out())).collect()}
    assert np.mean([(score[k] >= 0.5) == v for k, v in labels]) > 0.97


def test_odd_rows(spark):
    docs, labels = made(random.Random(2), 300)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = t.train(spark.createDataFrame(docs, "doc_id long, text string"), marks, ~t.held_out())
    for rows in (odd(spark), clashing(spark, ["score", "worst", "second", "size", "toxic", "_row", "SCORE_"])):
        got = t.score(rows, model).collect()
        assert len(got) == 9 and all(0 <= r["score"] < 0.5 for r in got)
    assert t.score(none(spark), model).count() == 0
    empty = t.train(odd(spark), marks.limit(0), ~t.held_out())
    assert [r["score"] for r in t.score(odd(spark), empty).collect()] == [0.0] * 9
    names = ["score", "WORST", "second", "size", "curve", "_row"]
    kept = t.reject_toxic(clashing(spark, names), marks)
    assert kept.schema == clashing(spark, names).schema and rows_of(kept) == rows_of(clashing(spark, names))
    long = spark.createDataFrame([(1, "x" * 1_000_000), (2, "scumbag" * 100_000), (3, "wortless " * 50_000)], "doc_id long, text string")
    assert [r["score"] > 0.5 for r in t.score(long, model).orderBy("doc_id").collect()][0::2] == [False, True]


def test_machine_and_curve():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=(200, 3)), np.ones(200)]).astype(np.float32)
    y = x[:, 0] + 0.5 > 0
    f = np.zeros(200)
    for _ in range(12):
        left, right = t.newton(x, f, 100.0 * y, 100.0 * ~y)
        f = x @ np.linalg.solve(left + np.diag([1, 1, 1, 1e-6]), right)
    assert ((f > 0) == y).mean() > 0.97
    slope, shift = t.logistic(x[:, :1].astype(float), y.astype(float), np.ones(200))
    assert slope > 0 and pytest.approx(0, abs=0.6) == slope * -0.5 + shift
