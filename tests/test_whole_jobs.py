"""Queries that have to do the whole job, on small tables."""

import json
import os
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tracewell.operators import features
from tracewell.operators import ranking as R
from tracewell.plans import prepare, reference, text_code
from tracewell.plans import virtual as V
from tracewell.session import table
from tracewell.streaming.hooks import opened_bugs, watch

D = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


def event(number, labels, action="opened"):
    return {"action": action, "issue": {"number": number, "title": f"t{number} & commitId: ab{number}", "body": "b", "labels": labels}, "repository": {"name": "r"}}


PAYLOADS = [
    (1, json.dumps(event(1, [{"name": "bug"}]))),
    (2, json.dumps([event(2, ["bug", None]), None, event(3, {"name": "bugfix"})])),
    (3, json.dumps({"payload": event(4, "bug")})),
    (4, json.dumps({"payload": json.dumps([event(5, [{"name": "ui"}]), event(None, [None, {"name": "a bug"}])])})),
    (5, json.dumps(event(6, ["bug"], "closed"))),
    (6, json.dumps(event(7, ["bug"]))[:-1]),
    (7, None),
    (8, '{"action": "opened", "issue": null}'),
]


def test_every_event_is_filtered(spark, tmp_path):
    spark.createDataFrame(PAYLOADS, "hook_id bigint, payload string").write.parquet(f"{tmp_path}/view_issue.parquet")
    rows = text_code.issue_filters(spark, str(tmp_path)).collect()
    assert sorted((r.hook_id, r.event_pos, r.bug) for r in rows) == [(1, 0, True), (2, 0, True), (2, 2, True), (3, 0, True), (4, 0, False), (4, 1, True), (5, 0, True), (8, 0, False)]


def test_every_opened_bug_is_found(spark, tmp_path):
    df = spark.createDataFrame(PAYLOADS, "hook_id bigint, payload string").selectExpr("hook_id", "timestamp '2024-01-01 00:00:00' as delivered_at", "payload")
    found = {1, 2, 3, 4, None}
    assert {r.number for r in opened_bugs(df).collect()} == found
    assert {r.commit for r in opened_bugs(df).collect()} == {f"ab{n}" for n in found}
    df.write.parquet(f"{tmp_path}/in")
    seen = []
    watch(spark, f"{tmp_path}/in", f"{tmp_path}/at", lambda b, _: seen.extend(r.number for r in b.collect())).awaitTermination(100)
    assert set(seen) == found


@needs_tables
def test_two_hops_are_undirected(spark):
    near = defaultdict(set)
    for r in V.call_edges(spark, D).collect():
        near[r.src].add(r.dst)
        near[r.dst].add(r.src)
    want = {p for v in near.values() for p in combinations(sorted(v), 2)}
    rows = reference.two_hops(spark, D).collect()
    assert len(rows) == len(want) and {(r.x, r.y) for r in rows} == want


def test_pool_leaves_out_the_own_group(spark):
    rows = spark.range(200).selectExpr("id as row_id", "case when id < 30 then 7 when id = 31 then null else id end as bug_id")
    pool = defaultdict(set)
    for r in R.other_rows(rows.where("row_id % 10 = 0 or row_id = 31"), rows, "row_id", "bug_id", 40).collect():
        assert r.b not in pool[r.a]
        pool[r.a].add(r.b)
    assert len(pool) == 21 and all(len(v) >= 40 for v in pool.values())
    assert not any(b < 30 for a, v in pool.items() for b in v if a < 30) and not any(a in v for a, v in pool.items())
    small = rows.where("row_id < 50")
    every = R.other_rows(small.where("row_id = 0"), small, "row_id", "bug_id", 40)
    assert {r.b for r in every.collect()} == set(range(30, 50))


@needs_tables
def test_hard_negatives_come_from_all_other_bugs(spark):
    bug = {r.row_id: r.bug_id for r in table(spark, D, "bug_reports").select("row_id", "bug_id").collect()}
    found = defaultdict(set)
    for r in reference.hard_negatives(spark, D).collect():
        found[r.a].add(r.b)
    assert set(found) == {i for i in bug if i % 50 == 0}
    assert all(len(v) == 20 and v <= set(bug) and bug[a] not in {bug[b] for b in v} for a, v in found.items())
    assert any(b < a for a, v in found.items() for b in v) and any(b > a + 9 for a, v in found.items() for b in v)


@needs_tables
def test_negatives_are_300_a_bug(spark):
    pool = defaultdict(set)
    for r in table(spark, D, "features").where("label = 0 and method_name is not null").collect():
        pool[r.bug_id].add(r.method_name)
    found = defaultdict(set)
    for r in reference.negatives(spark, D).collect():
        found[r.bug_id].add(r.method_name)
    assert {k: len(v) for k, v in found.items()} == {k: min(300, len(v)) for k, v in pool.items()}
    assert all(v <= pool[k] for k, v in found.items())


def test_vocabulary_has_5000_terms(spark, tmp_path):
    words = " ".join(f"w{i:04}" for i in range(5200))
    spark.createDataFrame([(1, words), (2, "w5100 w5100")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.doc_id, r.idx): r.n for r in reference.vocabulary_ids(spark, str(tmp_path)).collect()}
    assert rows == {**{(1, i): 1 for i in range(5000)}, (1, 5000): 200, (2, 0): 1}


@needs_tables
def test_candidates_made_in_tasks_are_those_of_the_joins(spark, monkeypatch):
    """Every method of every test report, without a shuffled row per candidate."""
    local = prepare.prepare(spark, D, "bug_id % 5 = 0")
    plan = prepare._prepared(spark, D, "bug_id % 5 = 0")[1]()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow")
    rows = [(*r[:5], *(round(x, 9) for x in r[5:7]), *r[7:]) for r in local.collect()]
    monkeypatch.setattr(features, "LOCAL_FIXES", -1)
    joined = [(*r[:5], *(round(x, 9) for x in r[5:7]), *r[7:]) for r in prepare.prepare(spark, D, "bug_id % 5 = 0").collect()]
    assert sorted(rows) == sorted(joined) and any(not r[3] and r[6] > 0 for r in rows)


@needs_tables
def test_places_without_rows_give_the_same_metrics(spark):
    """Test candidates are scaled, scored and ranked in the tasks that make them."""
    from tracewell.operators import model as M

    rows = prepare.prepare(spark, D).withColumn("label", F.col("label").cast("double")).localCheckpoint()
    train, test = (R.min_max(rows.where(c), prepare.SCORES) for c in ("train", "not train"))
    model = M.fit_scorer(train.withColumn("copies", F.when(F.col("label") == 1, 301).otherwise(1)), prepare.SCORES, weight="copies")
    want = R.metrics(M.score(model, test), "bug_id", "buggy_rate", "label", "method_id").first()
    df = prepare.learned_localisation(spark, D)
    assert "Sort" not in df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1]
    assert df.first() == pytest.approx(want, nan_ok=True) and want.n_groups
