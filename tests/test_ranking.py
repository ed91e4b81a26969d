import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ranking as R
from tracewell.operators.similarity import earlier_similar, nearest, pair_cosine


def test_history(spark):
    t = datetime
    rows = [(1, 7, t(2020, 2, 29)), (2, 7, t(2020, 3, 1)), (3, 7, t(2020, 3, 1)), (4, 7, t(2020, 3, 31)), (5, 8, t(2020, 1, 1)), (4, 7, t(2020, 3, 31))]
    got = {r.bug_id: (r.bff, r.bfr) for r in R.fix_history(spark.createDataFrame(rows, "bug_id int, method_id int, commit_time timestamp_ntz")).collect()}
    assert got == {1: (0, 0.0), 2: (1, 0.5), 3: (1, 0.5), 4: (3, 1.0), 5: (0, 0.0)}


def test_metrics(spark):
    rows = [(1, "a", 0.9, 0), (1, "b", 0.8, 1), (1, "c", 0.7, 1), (2, "x", 0.5, 0)]
    m = R.metrics(spark.createDataFrame(rows, "g int, i string, s double, l int"), "g", "s", "l", "i").first()
    assert (m.n_groups, m.hit_1, m.hit_5, round(m.map, 6), m.mrr) == (1, 0.0, 1.0, 0.583333, 0.5)
    assert R.metrics(spark.createDataFrame([], "g int, i string, s double, l int"), "g", "s", "l", "i").first().map is None


def test_scaling_split_and_sampling(spark):
    df = spark.createDataFrame([(i, float(i), 3.0) for i in range(5)], "k int, x double, c double")
    assert [(r.x, r.c) for r in R.min_max(df, ["x", "c"]).orderBy("k").collect()] == [(i / 4, 3.0) for i in range(5)]
    assert [r.split for r in R.split_by_time(df, 0.5, "c", "k").orderBy("k").collect()] == ["train"] * 2 + ["test"] * 3
    assert R.sample_by_hash(df, "c", "k", 3).count() == 3 and R.sample_by_hash(df, "c", "k", 30).count() == 5
    assert R.oversample(df, F.col("k") == 2, 3).count() == 8
    top = R.top_scores(df.select(F.lit(1).alias("query"), F.col("k").alias("node"), F.col("c").alias("score")), 2)
    assert sorted(r.node for r in top.collect()) == [3, 4]


def test_cosine(spark):
    texts = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["alpha", "gamma"]), (3, []), (4, ["x", "x"])], "id bigint, terms array<string>")
    pairs = spark.createDataFrame([(1, 2), (1, 1), (3, 1), (1, 4)], "a bigint, b bigint")
    got = {(r.a, r.b): r.score for r in pair_cosine(pairs, texts).collect()}
    assert math.isclose(got[1, 2], 1 / (1 + (math.log(1.5) + 1) ** 2)) and math.isclose(got[1, 1], 1) and got[3, 1] == got[1, 4] == 0


def test_earlier_similar(spark):
    texts = spark.createDataFrame([(i, i // 2, ["w%d" % (i % 3), "all"]) for i in range(40)] + [(99, None, ["all"]), (100, 3, None)], "id bigint, at bigint, terms array<string>")
    found = earlier_similar(texts.where("id in (10, 39)"), texts, 4, block_terms=1).collect()
    assert all(r.node // 2 < r.query // 2 for r in found)
    assert sorted(r.node for r in found if r.query == 39) == [27, 30, 33, 36]
    assert earlier_similar(texts.limit(0), texts).count() == 0


def earlier_by_hand(texts, asked, k):
    from collections import Counter

    w, out, counts = (math.log(1.5) + 1) ** 2, {}, {i: Counter(t) for i, _, t in texts}
    for q in asked:
        x, at = counts[q], dict((i, a) for i, a, _ in texts)
        found = []
        for i, a, _ in texts:
            y = counts[i]
            both = x.keys() & y.keys()
            if a < at[q] and both:
                own, other = (w * sum(n * n for n in z.values()) - (w - 1) * sum(z[t] ** 2 for t in both) for z in (x, y))
                found.append((round(sum(x[t] * y[t] for t in both) / math.sqrt(own * other), 9), i))
        out[q] = {(i, v) for v, i in sorted(found, reverse=True)[:k]}
    return out


@pytest.mark.parametrize("often", [1, 6000])
def test_earlier_similar_with_frequent_and_rare_terms(spark, often):
    """Terms in and beyond the matrices, ties, several tiles; with ``often``, norms that float32 doesn't hold."""
    import random

    r = random.Random(3)
    word = lambda: f"w{int(r.random() ** 3 * 900)}"
    texts = [(i, r.randrange(300), [word() for _ in range(r.randrange(1, 12))]) for i in range(1500)]
    texts += [(i, r.randrange(300), ["same", "w1"]) for i in range(1500, 1900)] + [(1900, 250, ["w1"] * often + ["w2"]), (1901, 120, ["w1"] * often)]
    df = spark.createDataFrame(texts, "id bigint, at bigint, terms array<string>").repartition(3)
    every = earlier_similar(df, df, 5).collect()
    asked = [*range(0, 1900, 60), 1899, 1900, 1901]
    assert {q: {(x.node, x.score) for x in every if x.query == q} for q in asked} == earlier_by_hand(texts, asked, 5)


def test_earlier_similar_is_not_by_posting_alone(spark):
    """1,200 queries and 24,000 texts of 30 of 50 terms each: posting by posting this took 30 s of a core."""
    import time

    texts = spark.range(24_000).selectExpr("id", "id as at", "transform(sequence(1, 30), i -> concat('w', pmod(xxhash64(id, i), 50))) as terms").localCheckpoint()
    earlier_similar(texts.limit(9), texts.limit(9)).count()
    began = time.perf_counter()
    assert earlier_similar(texts.where("id % 20 = 7"), texts.coalesce(1)).count() == 7 + 27 + 47 + 1197 * 50
    assert time.perf_counter() - began < 12


def test_cosine_of_pairs_against_counts(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    texts = {i: [f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 30))] for i in range(40)}
    pairs = [(a, b) for a in range(40) for b in range(a, 40, 3)] + [(1, 99)]
    df = spark.createDataFrame(list(texts.items()), "id bigint, terms array<string>")
    one = (math.log(1.5) + 1) ** 2

    def want(a, b):
        x, y = Counter(texts.get(a, [])), Counter(texts.get(b, []))
        norm = lambda u, v: sum(n * n * (1 if t in v else one) for t, n in u.items())
        return sum(x[t] * y[t] for t in x) / math.sqrt(norm(x, y) * norm(y, x)) if x and y else 0

    got = {(r.a, r.b): r.score for r in pair_cosine(spark.createDataFrame(pairs * 2, "a bigint, b bigint"), df).collect()}
    assert len(got) == len(pairs) and all(math.isclose(got[p], want(*p), abs_tol=1e-12) for p in pairs)


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, None), (6, [0.0, 0.0])], "id bigint, vector array<double>")
    found = {(r.query, r.node) for r in nearest(rows.where("id in (1, 3)"), rows, 2, 1).collect()}
    assert found == {(1, 4), (1, 2), (3, 2), (3, 6)}
    assert nearest(rows.limit(0), rows, 2).count() == 0
