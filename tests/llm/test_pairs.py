import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm.cooccurrence import _product, _Rows, _tiles, cooccurrence
from tracewell.llm.crosssplit import _bands, cross_links, cross_pairs, cross_rows, like_sets
from tracewell.llm.distinctive import term_scores
from tracewell.session import materialize


def pairs_of(baskets, min_count, min_ratio):
    n, items, both = len(baskets), Counter(), Counter()
    for b in baskets:
        items.update(b)
        both.update(itertools.combinations(sorted(b), 2))
    return {(x, y): c for (x, y), c in both.items() if c >= min_count and c * n >= min_ratio * items[x] * items[y]}


def test_cooccurrence_against_brute_force(spark):
    random.seed(1)
    baskets = [set(random.sample(range(60), random.choice([1, 2, 3, 5, 30]))) for _ in range(200)]
    rows = [(i, x) for i, b in enumerate(baskets) for x in b]
    rows += rows[:50] + [(None, 3), (4, None), (None, None)]
    df = spark.createDataFrame(rows, "record bigint, item bigint").withColumn("n", F.lit(1)).withColumn("size", F.lit(2))
    for count, ratio, block in ((1, 0.0, 256), (8, 1.2, 4), (3, 2.0, 7)):
        got = {(r.item_a, r.item_b): r.n_ab for r in cooccurrence(df, "record", "item", count, ratio, block).collect()}
        assert got == pairs_of(baskets, count, ratio) and (ratio == 2.0 or got)


def test_products_of_sparse_and_dense_blocks():
    rng = np.random.default_rng(1)
    for share in (0.02, 0.5):
        x, y = (rng.random((2, 40, 30)) < share).astype(int)
        rows = [_Rows(np.nonzero(m)[1], np.concatenate([[0], np.cumsum(m.sum(1))])) for m in (x, y)]
        code, n = _product(*rows, 30)
        want = (x.T @ y).ravel()
        assert code.tolist() == np.flatnonzero(want).tolist() and n.tolist() == want[want > 0].tolist()


def test_one_large_record_is_spread_over_tasks(spark):
    record = materialize(spark.range(3000).select(F.lit(1).alias("record"), F.col("id").alias("item")))
    tiles = _tiles(record, 100, 8)
    per_task = [r["count"] for r in tiles.groupBy(F.spark_partition_id()).count().collect()]
    assert tiles.count() == 30 * 31 / 2 and len(per_task) >= 8 and max(per_task) < 150
    assert cooccurrence(record.withColumn("record", F.explode(F.array(F.lit(1), F.lit(2)))), "record", "item", 2, 0.0, 100).count() == 3000 * 2999 / 2


def test_cooccurrence_counts_and_empty(spark):
    rows = [(i, x) for i in range(8) for x in (1, 2)] + [(i, 3) for i in range(8, 200)]
    r = cooccurrence(spark.createDataFrame(rows, "r bigint, i bigint"), "r", "i").first()
    assert (r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n_records, r.ratio) == (1, 2, 8, 8, 8, 200, 25.0)
    assert cooccurrence(spark.createDataFrame([], "r bigint, i bigint"), "r", "i").count() == 0


def test_term_scores_against_definition(spark):
    docs = {1: ["a", "b", "a"], 2: ["a", "c"], 3: [], 4: ["b", "é"], 5: ["x" * 5000]}
    df = spark.createDataFrame([*docs.items(), (None, ["a"]), (6, None), (7, [None])], "key bigint, terms array<string>").withColumn("term", F.lit("clash"))
    got = {(r.key, r.term): r for r in term_scores(df, "key", "terms", 2, 10.0).collect()}
    flat = [t for d in docs.values() for t in d]
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (4, "b")}
    for (k, t), r in got.items():
        q = flat.count(t) / len(flat)
        p = (docs[k].count(t) + 10 * q) / (len(docs[k]) + 10)
        assert math.isclose(r.score, p * math.log(p / q)) and (r.n_records, r.n_terms, r.tf) == (4, len(flat), docs[k].count(t))
    assert term_scores(df.limit(0), "key", "terms").count() == 0


def mutated(base, rng):
    s = set(base)
    for _ in range(rng.randint(0, max(1, len(s) // 6))):
        if rng.random() < 0.5 and len(s) > 8:
            s.remove(rng.choice(sorted(s)))
        else:
            s.add(f"n{rng.randint(0, 10**6)}")
    return s


def jaccard(a, b):
    return len(a & b) * 5 >= len(a | b) * 4


def test_like_sets_lose_no_pair(spark):
    rng = random.Random(5)
    bases = [{f"w{rng.randint(0, 80)}" for _ in range(n)} for n in (10, 12, 14, 20, 24, 25, 40, 60, 90, 200) for _ in range(6)]
    sets = [s for s in (mutated(b, rng) for b in bases for _ in range(8)) if len(s) >= 8]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, t array<string>").select("id", F.transform("t", lambda t: F.xxhash64(t)).alias("h"))
    got = {(r.left_id, r.right_id) for r in like_sets(df.where("id % 2 = 0"), df.where("id % 2 = 1")).collect()}
    true = {(i, j) for i in range(0, len(sets), 2) for j in range(1, len(sets), 2) if jaccard(sets[i], sets[j])}
    assert got == true and len(true) > 500


def test_ranges_hold_all_like_sizes():
    bands = _bands(largest=5000)
    at = lambda n: next(i for i, (a, b) in enumerate(bands) if a <= n <= b)
    assert all(at(b) - at(a) <= 1 for a in range(8, 1000) for b in range(a, a * 5 // 4 + 1))


def test_cross_pairs(spark):
    words = [f"w{i}" for i in range(10)]
    rows = [
        (1, 1, "train", words), (2, 2, "test", words[::-1] + ["w1"]), (3, 3, "valid", words[:9] + ["q"]), (4, 1, "test", []), (5, 4, None, words), (6, 5, "train", words[:7]), (7, 6, "test", words[:7]),
        (8, None, "test", words), (9, 7, "train", words), (10, None, "train", None),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, bug_id bigint, side string, terms array<string>").withColumn("class_id", F.lit(0))
    got = {(r.row_id_a, r.row_id_b, r.same_bug) for r in cross_pairs(df, short_copies=False).collect()}
    like = {(1, 3), (3, 9)} if 9 / 11 >= 0.8 else set()
    assert {(a, b) for a, b, _ in got} == {(1, 2), (1, 8), (2, 9), (8, 9), (1, 4), *like}
    assert {(a, b) for a, b, s in got if s} == {(1, 4)}
    assert cross_pairs(df.limit(0)).count() == 0
    members, links = cross_links(df)
    assert {r.class_id for r in members.collect() if r.row_id in (1, 2, 8, 9)} == {1}
    assert (1, 1) in {(r.train_class, r.eval_class) for r in links.collect()}


def test_short_copies_and_other_similarities(spark):
    rows = [(1, 1, "train", ["a", "b"]), (2, 2, "test", ["b", "a", "a"]), (3, 3, "test", ["a"]), (4, 4, "train", []), (5, 5, "test", None), (6, 6, "train", list("abcdef")), (7, 7, "valid", list("abcxyz")), (8, 6, "test", ["q"])]
    df = spark.createDataFrame(rows, "row_id bigint, bug_id bigint, side string, terms array<string>").withColumn("n", F.lit(1))
    assert {(r.row_id_a, r.row_id_b) for r in cross_pairs(df).collect()} == {(1, 2), (6, 8)}
    assert {(r.row_id_a, r.row_id_b) for r in cross_pairs(df, short_copies=False).collect()} == {(6, 8)}
    half = {(r.row_id_a, r.row_id_b) for r in cross_pairs(df, min_terms=1, similarity=0.33).collect()}
    assert half == {(1, 2), (1, 3), (1, 7), (2, 6), (6, 7), (6, 8)}
    found = {r.row_id: (r.class_id, r.n_terms, r.n_links, r.n_long_links, r.same_bug) for r in cross_rows(df).collect()}
    assert found == {1: (1, 2, 1, 0, False), 2: (1, 2, 1, 0, False), 3: (3, 1, 0, 0, False), 4: (None, 0, 0, 0, False), 5: (None, 0, 0, 0, False), 6: (6, 6, 0, 0, True), 7: (7, 6, 0, 0, False), 8: (8, 1, 0, 0, True)}


def test_like_sets_at_other_similarities_lose_no_pair(spark):
    rng = random.Random(8)
    sets = [{f"w{rng.randint(0, 12)}" for _ in range(rng.randint(1, 12))} for _ in range(120)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, t array<string>").select("id", F.transform("t", lambda t: F.xxhash64(t)).alias("h"))
    for least, s in ((1, 0.5), (3, 0.65), (1, 1.0)):
        got = {(r.left_id, r.right_id) for r in like_sets(df.where(f"id % 2 = 0 and size(h) >= {least}"), df.where(f"id % 2 = 1 and size(h) >= {least}"), least, s).collect()}
        assert got == {(i, j) for i in range(0, 120, 2) for j in range(1, 120, 2) if min(len(sets[i]), len(sets[j])) >= least and len(sets[i] & sets[j]) >= s * len(sets[i] | sets[j])}
