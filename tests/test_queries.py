"""Queries against their SQL on the smallest tables, and plans without cross joins."""

import os

import duckdb
import pytest

from tracewell.plans import prepare, reference, text_code, training

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
CASES = [(m, n) for m in (reference, text_code, training, prepare) for n in m.SQL]


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


#: Joins without keys with a table of one row (bounds, totals, metadata), which can't be expressed otherwise.
ONE_ROW = {"scaled", "split_by_time", "graph_metadata", "extracted_commit", "features_prepared", "learned_localisation", "hard_negatives"}


def test_no_cartesian_product(spark):
    for m in (reference, text_code, training, prepare):
        for name, q in m.QUERIES.items():
            if name == "learned_metrics" or name.startswith(("learned", "features")):
                continue  # several minutes of fitting and storing; their parts are in the other queries
            plan = q(spark, D)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan, name
            assert "BroadcastNestedLoopJoin" not in plan or name in ONE_ROW, name
