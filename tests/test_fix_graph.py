import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import fix_graph as X
from tracewell.plans import reference
from tracewell.plans import virtual as V

D = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def graph(spark):
    return X.fix_graph(V.report_methods(spark, D), V.reports(spark, D).selectExpr("bug_id as node", "commit_time as at"))


@needs_tables
def test_scores_are_made_in_tasks_without_a_row_per_summand(spark, monkeypatch):
    df = reference.collaborative(spark, D)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow") and "Join" not in plan and "Aggregate" not in plan
    found = rows(df)
    monkeypatch.setattr(reference, "fix_graph", lambda *_: None)
    joined = rows(reference.collaborative(spark, D))
    assert [r[:2] for r in found] == [r[:2] for r in joined] and found
    assert [r[2] for r in found] == pytest.approx([r[2] for r in joined], abs=1e-9)


@needs_tables
def test_pieces_give_the_same_scores(spark, monkeypatch):
    """Many summands are held a piece at a time, and distant methods are found by sorting."""
    g = X._opened(graph(spark))
    n = np.arange(40)
    q, score, asked = n // 10, 0.1 + n / 100, np.full(4, np.sort(g.at)[len(g.at) // 2])
    method, own = np.array([3, 5, 100]), np.array([0.0, 0.2, 0.3])
    reports, methods = X._reports(g, q, asked, n, score, 5), X._scores(g, method, own)
    assert set(method) < set(methods[0]) and len(reports[0]) > 40
    monkeypatch.setattr(X, "HELD", 20)
    for whole, pieces in zip((*reports, *methods), (*X._reports(g, q, asked, n, score, 5), *X._scores(g, method, own))):
        assert pieces == pytest.approx(whole)
    monkeypatch.setattr(X, "HELD", 2_000_000)
    few = X.SimpleNamespace(method_ids=np.arange(1000), link_size=np.eye(1, 1000, dtype=int)[0], link_start=np.minimum(np.arange(1001), 1), link_values=np.array([999]), link_common=np.array([1]), method_size=np.ones(1000, int))
    found, total = X._scores(few, np.array([0, 1]), np.array([0.0, 0.5]))
    assert list(found) == [0, 1, 999] and list(total) == [0, 0.5, 1]


def test_odd_tables_take_the_joins(spark):
    """Ids that are null and reports with two times aren't for lists; repeated fixes, unknown times and empty tables are."""
    day = datetime(2020, 1, 1)
    times = lambda *x: spark.createDataFrame([(i, day + timedelta(d) if d is not None else None) for i, d in x], "node bigint, at timestamp_ntz")
    fixes = lambda *x: spark.createDataFrame(list(x), "bug_id bigint, method_id bigint")
    assert X.fix_graph(fixes((1, 2), (None, 2)), times((1, 1))) is None and X.fix_graph(fixes((1, None)), times((1, 1))) is None
    assert X.fix_graph(fixes((1, 2)), times((1, 1), (1, 2))) is None
    g = X._opened(X.fix_graph(fixes((9, 7), (4, 7), (9, 7), (9, -5)), times((9, 1), (4, None), (5, 1))))
    assert list(g.bug_ids) == [4, 9] and list(g.method_ids) == [-5, 7] and list(g.bug_values) == [1, 0, 1] and list(g.method_values) == [1, 0, 1]
    assert g.at[0] == X.NEVER > g.at[1] and list(g.link_values) == [1, 0] and list(g.link_common) == [1, 1]
    none = X.fix_graph(fixes(), times())
    best = spark.createDataFrame([(50, 5, 9, 0.1)], "query bigint, at bigint, node bigint, score double")
    assert none and X.graph_scores(none, best).collect() == []
    one = X.fix_graph(fixes((9, 7), (9, 8), (4, 7)), times((9, 0), (4, 1)))
    at = int((day + timedelta(3) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    got = {r.method_id: r.cfs for r in X.graph_scores(one, best.withColumn("at", F.lit(at))).collect()}
    assert got == {7: pytest.approx(1.05), 8: pytest.approx(0.55)}
