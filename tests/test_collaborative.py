import os
from collections import defaultdict

import pytest

from tracewell.plans import reference
from tracewell.plans import virtual as V
from tracewell.session import table

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


def jaccard(sets):
    by = defaultdict(set)
    for k, v in sets.items():
        for x in v:
            by[x].add(k)
    return {a: {b: len(x & sets[b]) / len(x | sets[b]) for b in set().union(*(by[m] for m in x)) - {a}} for a, x in sets.items()}


def best(scores, k=50):
    return dict(sorted(scores.items(), key=lambda i: (i[1], i[0]), reverse=True)[:k])


def test_scores_spread_over_true_links(spark):
    fixed, reports = defaultdict(set), defaultdict(set)
    for r in V.report_methods(spark, D).collect():
        fixed[r.bug_id].add(r.method_id)
        reports[r.method_id].add(r.bug_id)
    commits, methods = jaccard(fixed), jaccard(reports)
    orders, want = table(spark, D, "orders").collect(), {}
    at = {o.o_orderkey: o.o_orderdate for o in orders}
    for q in (o for o in orders if o.o_orderkey % 50 == 0):
        seeds = best({o.o_orderkey: round(o.o_totalprice / 1e6, 3) for o in orders if o.o_custkey == q.o_custkey and o.o_orderdate < q.o_orderdate})
        spread, cfs = defaultdict(float), defaultdict(float)
        for c in seeds:
            for n, sim in commits.get(c, {}).items():
                spread[n] += sim / len(commits[c])
        score = defaultdict(float, seeds)
        for n, x in best({n: round(x, 12) for n, x in spread.items() if at[n] < q.o_orderdate}).items():
            score[n] += x
        for c, x in score.items():
            for m in fixed.get(c, ()):
                cfs[m] += x / len(fixed[c])
        for m in list(cfs):
            for n, sim in methods[m].items():
                cfs[n] += sim / len(methods[m])
        want |= {(q.o_orderkey, m): x for m, x in cfs.items()}
    got = {(r.query, r.method_id): r.cfs for r in reference.collaborative(spark, D).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_blocks_of_a_hot_method_give_the_same_links(spark):
    of = table(spark, D, "orders").selectExpr("o_orderkey as node").where("node % 50 = 0")
    assert sorted(V.report_links(spark, D, of, 7).collect()) == sorted(V.report_links(spark, D, of).collect())
