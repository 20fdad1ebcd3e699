"""Every query against its SQL in DuckDB, on whole tables."""

import math

import duckdb
import pytest

from loomgraph.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(tuple(r[i] for i in order) for r in want.fetchall())
