"""Each query against its SQL at the smallest scale."""

import duckdb
import pytest

from hyperloom.plans import corpus_queries, structure_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(corpus_queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = corpus_queries.QUERIES[name](spark, SF)
    cur = duck.execute(corpus_queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r[n] for n in sorted(names)) for r in got.collect()), key=str) == want


def test_flagship(spark):
    rows = corpus_queries.flagship(spark, SF).collect()
    assert len(rows) == 150 and sum(r["is_acyclic"] for r in rows) == 12
