import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.operators.pit import known_at

EVENTS, CHANGES = "entity bigint, at bigint, note string", "entity bigint, known bigint, since bigint, version int"


def run(spark, events, changes, **kw):
    c = spark.createDataFrame(changes, CHANGES).select("entity", "known", F.when(F.col("since").isNotNull(), F.struct("since", "version")).alias("state"))
    rows = known_at(spark.createDataFrame(events, EVENTS), c, base_width=1000, **kw).collect()
    return sorted(((r.entity, r.at, r.note, None if r.state is None else (r.state.since, r.state.version)) for r in rows if r.entity is not None), key=str)


def brute(events, changes):
    out = []
    for e, at, note in events:
        if e is not None and at is not None and (best := max(((s, v) for c, k, s, v in changes if c == e and k is not None and k <= at and s is not None), default=None)):
            out.append((e, at, note, best))
    return sorted(out, key=str)


def test_late_knowledge_ties_and_nulls(spark):
    changes = [(1, 10, 10, 1), (1, 10, 10, 2), (1, 500, 5, 9), (1, 5000, 20, 3), (1, 10, 10, 2), (2, None, 1, 1), (None, 1, 1, 1), (3, 7, None, None)]
    events = [(1, 9, "a"), (1, 10, "a"), (1, 600, "a"), (1, 4999, "a"), (1, 5000, "a"), (1, 5000, "a"), (2, 50, None), (3, 50, None), (1, None, "a"), (None, 5, "a")]
    assert run(spark, events, changes) == brute(events, changes)
    assert len([r for r in run(spark, events, changes, how="left") if r[3] is None]) == 4


def test_random_and_busy_entity_against_brute_force(spark):
    random.seed(3)
    changes = [(random.choice([1, 1, 1, 2, 3]), random.randint(0, 9000), random.randint(0, 40), random.randint(1, 5)) for _ in range(600)]
    events = [(random.choice([1, 2, 4]), random.randint(0, 10_000), str(i)) for i in range(300)]
    assert run(spark, events, changes, per_bucket=4) == brute(events, changes)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1, 1)]) == [] and run(spark, [(1, 1, "a")], []) == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 3000), st.integers(0, 5), st.integers(1, 3)), max_size=20))
def test_any_changes(changes):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    events = [(e, t, "x") for e in (1, 2) for t in (0, 999, 1000, 1001, 2500, 9999)]
    assert run(spark, events, changes, per_bucket=2) == brute(events, changes)


def test_far_dates_and_hot_keys(spark):
    far = 250_000_000
    changes = [(e, 10 * e, e, 1) for e in range(50)] + [(1, far, 9, 9)]
    events = [(e, t, "x") for e in range(50) for t in (5, 900, far // 2, far + 5)] + [(1, 950, str(i)) for i in range(400)] + [(7, 100, "same")] * 300
    assert run(spark, events, changes, hot_share=10) == brute(events, changes)


def test_extra_columns_with_clashing_names(spark):
    c = spark.createDataFrame([(1, 5, 1)], "entity bigint, known bigint, v int").select("entity", "known", F.struct("v").alias("state"), F.lit(1).alias("width"))
    e = spark.createDataFrame([(1, 9, "a", 3, None)], "entity bigint, at bigint, width string, bucket int, since string")
    assert [tuple(r) for r in known_at(e, c).collect()] == [(1, 9, "a", 3, None, (1,))]
