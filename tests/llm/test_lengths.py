from loomgraph.llm import lengths as n
from tests.llm.common import documents, none, odd
from tests.llm.test_packing import brute_ids


def test_query_and_limits(spark, sf):
    have = sorted(len(x) - 1 for x in brute_ids([t for _, t in documents(spark, sf)]))
    got = {r["length"]: r for r in n.op1_token_counts(spark, sf).collect()}
    assert sorted(got) == sorted(set(have))
    for v, r in got.items():
        assert (r["n_docs"], r["docs_to"], r["tokens_to"]) == (have.count(v), sum(x <= v for x in have), sum(x for x in have if x <= v))
        assert (r["docs_over"], r["tokens_over"]) == (sum(x > v for x in have), sum(x for x in have if x > v))
        assert r["truncated_tokens"] == sum(min(x, v) for x in have) and r["quantile"] == r["docs_to"] / len(have)
    limits = spark.createDataFrame([(0,), (100,), (1000,), (10**6,), (None,)], "context long")
    for r in n.at_limits(n.op1_token_counts(spark, sf), limits).collect():
        v = r["context"]
        assert (r["docs_to"], r["tokens_to"], r["truncated_tokens"]) == (sum(x <= v for x in have), sum(x for x in have if x <= v), sum(min(x, v) for x in have))


def test_odd_rows(spark):
    got = {r["length"]: r["n_docs"] for r in n.suffix_sums(n.histogram(n.token_lengths(odd(spark)))).collect()}
    assert got[0] == 3 and sum(got.values()) == 9
    assert n.suffix_sums(n.histogram(n.token_lengths(none(spark)))).count() == 0
