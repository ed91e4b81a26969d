import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.llm.ideal_point import closeness, places, ranking
from tracewell.llm.topn import split_heavy, top_n

SCORE = "g bigint, item string, a double, b double, c double"


def rows(n=400, seed=2):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), -1.0, 0.0, -0.0, 1.0, rng.random() * 1000])
    return [(1 if i % 2 else i % 7, f"m{i}", value(), value(), value()) for i in range(n)]


def true_places(data):
    out = {}
    for g in {r[0] for r in data}:
        own = [r for r in data if r[0] == g]
        ok = lambda v: v is not None and not math.isnan(v) and v >= 0
        for r in own:
            out[g, r[1]] = [1 + sum(ok(o[k]) and o[k] > r[k] for o in own) if ok(r[k]) else len(own) + 1 for k in (2, 3, 4)]
    return out


@pytest.mark.parametrize("heavy", [50_000, 100])
def test_places_light_and_heavy(spark, heavy):
    data = rows()
    df = spark.createDataFrame(data, SCORE).cache()
    got = {(r.g, r["item"]): [r._p0, r._p1, r._p2] for r in places(df, "g", "item", ["a", "b", "c"], heavy).collect()}
    assert got == true_places(data)


@pytest.mark.parametrize("heavy", [50_000, 100])
def test_closeness_by_place_orders_by_sum_of_places(spark, heavy):
    data = rows()
    close = closeness(spark.createDataFrame(data, SCORE).cache(), "g", "item", ["a", "b", "c"], scale="place", heavy_rows=heavy).cache()
    got = {(r.g, r["item"]): r.rnk for r in ranking(close, "g", [F.col("closeness").desc(), F.col("item").desc()], heavy_rows=heavy).collect()}
    p = true_places(data)
    for g in {r[0] for r in data}:
        best = sorted(sorted((i for h, i in p if h == g), reverse=True), key=lambda i: sum(p[g, i]))
        assert [got[g, i] for i in best] == list(range(1, len(best) + 1))


def test_vector_scale(spark):
    df = spark.createDataFrame([(1, "x", 1000.0, 0.1, 0.0), (1, "y", 0.0, 0.2, 0.0), (1, "z", None, float("nan"), 0.0), (2, "only", 5.0, 5.0, 5.0), (3, "q", None, None, None)], SCORE)
    got = {r["item"]: r.closeness for r in closeness(df, "g", "item", ["a", "b", "c"]).collect()}
    n = math.hypot(0.1, 0.2, 0.1)
    up, down = 0.1 / n, 1.0
    assert math.isclose(got["x"], down / (up + down)) and got["x"] > got["y"] > got["z"] == 0.0
    assert got["only"] == got["q"] == 0.5
    assert closeness(df.limit(0), "g", "item", ["a"]).count() == closeness(df.limit(0), "g", "item", ["a"], scale="place").count() == 0


@pytest.mark.parametrize("heavy", [50_000, 100])
def test_top_n(spark, heavy):
    rng = random.Random(4)
    data = [(None if i % 50 == 0 else 1 if i % 2 else i % 9, f"m{i:04}", float(rng.randint(0, 5))) for i in range(900)]
    df = spark.createDataFrame(data, "g int, m string, s double").withColumn("_n", F.lit(0)).cache()
    got = {}
    for r in top_n(df, ["g"], [F.col("s").desc(), F.col("m").desc()], 4, heavy_rows=heavy).collect():
        got.setdefault(r.g, {})[r.rnk] = r.m
    for g in {r[0] for r in data}:
        best = sorted(sorted((r[1:] for r in data if r[0] == g), reverse=True), key=lambda r: -r[1])[:4]
        assert [got[g][k] for k in sorted(got[g])] == [m for m, _ in best]
    assert top_n(df.limit(0), ["g"], [F.col("s")], 4).count() == 0
    with pytest.raises(ValueError):
        top_n(df.withColumn("rnk", F.lit(1)), ["g"], [F.col("s")], 4)


@pytest.mark.parametrize(("heavy", "limit"), [(100, 100_000), (100, 0)])
def test_vector_scale_of_heavy_groups_is_that_of_light_ones(spark, heavy, limit):
    df = spark.createDataFrame([*rows(), (None, "n", 1.0, 1.0, 1.0)], SCORE).cache()
    of = lambda **k: {(r.g, r["item"]): r.closeness for r in closeness(df, "g", "item", ["a", "b", "c"], **k).collect()}
    light = of()
    assert len(light) == 400 and of(heavy_rows=heavy, limit=limit) == pytest.approx(light, abs=1e-12)


def test_many_heavy_groups_are_joined_by_salts(spark):
    df = spark.createDataFrame([(i % 5, f"m{i:04}") for i in range(1000)] + [(None, "n")], "g int, m string").cache()
    heavy, light = split_heavy(df, ["g"], 100, 0)
    assert sorted(r.m for r in heavy.collect()) == [f"m{i:04}" for i in range(1000)] and [r.m for r in light.collect()] == ["n"]
