"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tracewell.llm import queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
CASES = [(queries, n) for n in queries.SQL]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{D}/{f}')")
    return c


def values(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_query(spark, duck, module, name):
    df = module.QUERIES[name](spark, D)
    q = duck.execute(module.SQL[name])
    columns = [c[0] for c in q.description]
    assert sorted(columns) == sorted(df.columns)
    assert values(map(tuple, df.collect()), df.columns) == values(q.fetchall(), columns)
