"""Fix history, neighbour scores, sampling, scaling and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import range_sums


def month_distance(a: Column, b: Column) -> Column:
    """Calendar months between two times, whatever their days."""
    return F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b))


def fix_history(fixes: DataFrame) -> DataFrame:
    """(bug_id, method_id, bff, bfr) of (bug_id, method_id, commit_time): how many strictly earlier reports fixed the method, and
    ``1 / (months since the latest of them + 1)``; 0 without any.

    Fixes are counted per method and time first, so the window of a popular method holds one row per distinct time and
    the reports of that time are joined back by (method, time).
    """
    per_time = fixes.groupBy("method_id", "commit_time").agg(F.count_distinct("bug_id").alias("n"))
    w = Window.partitionBy("method_id").orderBy("commit_time")
    before = per_time.select("method_id", "commit_time", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bff"), F.lag("commit_time").over(w).alias("latest"))
    recency = F.coalesce(1.0 / (month_distance(F.col("commit_time"), F.col("latest")) + 1), F.lit(0.0))
    return fixes.join(before, ["method_id", "commit_time"]).select("bug_id", "method_id", "bff", recency.alias("bfr")).distinct()


def shared_scores(scores: DataFrame, links: DataFrame) -> DataFrame:
    """(query, neighbour, score): each node's score dealt evenly to its neighbours and summed per neighbour.

    ``scores``: (query, node, score); ``links``: (node, neighbour), once each.
    """
    degree = links.groupBy("node").agg(F.count("*").alias("_deg"))
    dealt = scores.join(degree, "node").join(links, "node")
    return dealt.groupBy("query", "neighbour").agg(F.sum(F.col("score") / F.col("_deg")).alias("score"))


def top_scores(scores: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best rows of each query by (score, node), both descending."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("node").desc())
    return scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def linked_scores(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(query, node, score): for each (query, node) its neighbours with ``sim / degree`` of the link (node, neighbour, sim)."""
    degree = links.groupBy("node").agg(F.count("*").alias("_deg"))
    return nodes.select("query", "node").join(degree, "node").join(links, "node").select("query", F.col("neighbour").alias("node"), (F.col("sim") / F.col("_deg")).alias("score"))


def collaborative(seeds: DataFrame, commit_links: DataFrame, fixed: DataFrame, method_links: DataFrame, k: int = 50, times: DataFrame | None = None) -> DataFrame:
    """(query, method_id, cfs): collaborative-filtering scores of methods for each query report.

    ``seeds``: (query, node, score), the similarity of a query to earlier reports. The best ``k`` add ``sim / degree`` to the reports linked
    with them (node, neighbour, sim), the best ``k`` of which join in, but never the query itself; every report deals its score to the
    methods that it fixed (node, method_id); then each scored method adds ``sim / degree`` to its own neighbours (node, neighbour, sim), once.
    With ``times`` (node, at) of all reports only those strictly earlier than the query take part, linked ones too; one without a time doesn't.
    """

    def earlier(scores: DataFrame) -> DataFrame:
        if times is None:
            return scores.where("query <> node")
        asked = times.select(F.col("node").alias("query"), F.col("at").alias("_asked"))
        return scores.join(times.select("node", "at"), "node").join(asked, "query").where("at < _asked").select("query", "node", "score")

    best = top_scores(earlier(seeds), k)
    spread = linked_scores(best, commit_links).groupBy("query", "node").agg(F.round(F.sum("score"), 12).alias("score"))
    reports = best.unionByName(top_scores(earlier(spread), k)).groupBy("query", "node").agg(F.sum("score").alias("score"))
    methods = shared_scores(reports, fixed.select("node", F.col("method_id").alias("neighbour"))).withColumnRenamed("neighbour", "node")
    more = linked_scores(methods, method_links)
    return methods.unionByName(more).groupBy("query", F.col("node").alias("method_id")).agg(F.sum("score").alias("cfs"))


def sample_by_hash(pool: DataFrame, group: str, item: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` items of each group without replacement, all of a smaller group; the same ones every time."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col(item).cast("string"))), item)
    return pool.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def oversample(rows: DataFrame, positive: Column, copies: int) -> DataFrame:
    """Every positive row ``copies`` more times, numbered in ``copy``."""
    n = F.when(positive, copies).otherwise(0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), n)))


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1] over all rows; a constant column stays. The bounds are one row, joined to each."""
    bounds = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    both = rows.join(F.broadcast(bounds))
    scaled = {c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(F.col(c)) for c in columns}
    return both.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in rows.columns])


def split_by_time(rows: DataFrame, ratio: float, time: str, key: str) -> DataFrame:
    """``split`` = train for the first ``int(n * ratio)`` rows by (time, key), test for the rest; equal times by key.

    Ranks come from counts per time, summed by ranges of time, so no task sorts all rows or all times.
    """
    per = rows.groupBy(time).agg(F.count("*").alias("_c"))
    before = range_sums(per, [], [F.col(time).asc()], {"_before": "_c"})
    total = rows.agg(F.floor(F.count("*") * F.lit(ratio)).alias("_cut"))
    placed = rows.join(before.drop("_c"), rows[time].eqNullSafe(before[time])).drop(before[time]).join(F.broadcast(total))
    placed = placed.withColumn("_n", F.col("_before") + F.row_number().over(Window.partitionBy(time).orderBy(key)))
    return placed.withColumn("split", F.when(F.col("_n") <= F.col("_cut"), "train").otherwise("test")).select(*rows.columns, "split")


def ranked(rows: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Rows with their place in the group by score descending, ties by ``tie`` ascending."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))))


def metrics(rows: DataFrame, group: str, score: str, label: str, tie: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: groups with a true item, hit@k for each k, MAP and MRR. Nulls if no group has one.

    The place of a true item is counted against the rows before it, and only true items are kept after ranking.
    """
    return metrics_of_places(ranked(rows, group, score, tie).where(F.col(label) == 1), group, ks)


def metrics_of_places(true: DataFrame, group: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``metrics`` of the true items (group, rank)."""
    j = F.row_number().over(Window.partitionBy(group).orderBy("rank"))
    per = true.withColumn("_p", j / F.col("rank")).groupBy(group).agg(F.min("rank").alias("first"), F.avg("_p").alias("ap"))
    hits = [F.avg((F.col("first") <= k).cast("double")).alias(f"hit_{k}") for k in ks]
    return per.agg(F.count("*").alias("n_groups"), *hits, F.avg("ap").alias("map"), F.avg(1.0 / F.col("first")).alias("mrr"))


def visible_history(reports: DataFrame) -> DataFrame:
    """(bug_id, n_visible) of (bug_id, commit_time, split): the strictly earlier reports a report may learn from.

    Training reports see training reports only, test reports see all. Counted from one row per time and split, summed by ranges of time.
    """
    per = reports.groupBy("commit_time").agg(F.count("*").alias("_n"), F.count_if(F.col("split") == "train").alias("_n_train"))
    before = range_sums(per, [], [F.col("commit_time").asc()], {"n": "_n", "n_train": "_n_train"})
    return reports.join(before, "commit_time").select("bug_id", F.when(F.col("split") == "train", F.col("n_train")).otherwise(F.col("n")).alias("n_visible"))


def hash_number(*values: Column) -> Column:
    """A number below 2**60 from the MD5 hash of values, the same in any engine."""
    return F.conv(F.left(F.md5(F.concat_ws("|", *values)), F.lit(15)), 16, 10).cast("bigint")


def other_rows(queries: DataFrame, rows: DataFrame, key: str, group: str, k: int, buckets: int = 4096) -> DataFrame:
    """(a, b): for each query row a random sample of rows ``b`` of other groups, at least ``k`` of them or all there are.

    All rows stand in the order of a hash of their unique ``key``, as in a circle. A query takes the places from one that its own hash names
    on: ``k`` and as many as its group has rows, so that ``k`` are left without those. Joined by place, no cross join; the window
    without partition holds one row per hash bucket.
    """
    h = hash_number(F.lit("place"), F.col(key))
    bucket = F.pmod(h, F.lit(buckets))
    at = rows.select(F.col(key).alias("b"), F.col(group).alias("_group_b"), bucket.alias("_bucket"), h.alias("_h"))
    n = at.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = n.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", "b"))
    placed = at.withColumn("_own", own).join(before, "_bucket").select("b", "_group_b", (F.col("_before") + F.col("_own") - 1).alias("_place"))
    total = rows.count()
    if not total:
        return queries.select(F.col(key).alias("a"), F.col(key).alias("b")).limit(0)
    same = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_same"))
    q = queries.select(F.col(key).alias("a"), F.col(group).alias("_group_a"))
    sized = q.join(same, F.col("_group_a").eqNullSafe(F.col("_group"))).withColumn("_from", F.pmod(hash_number(F.lit("from"), F.col("a")), F.lit(total)))
    steps = F.sequence(F.lit(0), F.least(F.lit(total), F.col("_same") + k).cast("int") - 1)
    wanted = sized.select("a", "_group_a", "_from", F.explode(steps).alias("_step")).select("a", "_group_a", F.pmod(F.col("_from") + F.col("_step"), F.lit(total)).alias("_place"))
    return wanted.join(placed, "_place").where(~F.col("_group_a").eqNullSafe(F.col("_group_b"))).select("a", "b")


def hard_negatives(pool: DataFrame, texts: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(a, b, score): of ``2 * k`` sampled partners ``b`` of each ``a`` the ``k`` with the most similar texts (id, terms)."""
    from .similarity import pair_cosine

    sampled = sample_by_hash(pool.select("a", "b"), "a", "b", 2 * k, seed)
    scored = pair_cosine(sampled, texts).withColumn("score", F.round("score", 9))
    return top_scores(scored.select(F.col("a").alias("query"), F.col("b").alias("node"), "score"), k).select(F.col("query").alias("a"), F.col("node").alias("b"), "score")


def shuffled(rows: DataFrame, key: str, seed: int = 0, place: str = "place") -> DataFrame:
    """``rows`` with their ``place`` (from 0) in a random order that depends on the seed and the unique ``key`` only; no task sorts them all."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_one", F.lit(1))
    return range_sums(hashed, [], [F.col("_h"), F.col(key)], {place: "_one"}).drop("_h", "_one")


def greatest_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vector): the element-wise maximum of each group's vectors (max-pooling); null and NaN elements don't count, an element without
    any other is null. Elements are folded map-side, so no group is collected."""
    each = rows.select(group, F.posexplode(vector).alias("_i", "_x")).groupBy(group, "_i").agg(F.max(F.when(~F.isnan("_x"), F.col("_x"))).alias("_x"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias(vector))
