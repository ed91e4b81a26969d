"""Preparing the features of candidate methods: links, candidates, fix history of any candidate, and their assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import micros
from ..session import materialize
from .graph import undirected
from .ranking import collaborative, hash_number, month_distance, top_scores


def _jaccard(common: DataFrame, a: str, b: str, sizes: DataFrame, key: str, name: str) -> DataFrame:
    """(a, b, name): ``common`` (a, b, c) with the Jaccard score of the two sets, whose sizes are (key, n)."""
    both = common.join(sizes.select(F.col(key).alias(a), F.col("n").alias("_n1")), a).join(sizes.select(F.col(key).alias(b), F.col("n").alias("_n2")), b)
    return both.select(a, b, (F.col("c") / (F.col("_n1") + F.col("_n2") - F.col("c"))).alias(name))


def method_links(fixed: DataFrame, block: int = 256) -> DataFrame:
    """(method1, method2, sim_score) of stored (bug_id, method_id): methods fixed by a common report, smaller first, with the Jaccard score of
    their report sets.

    A report of many methods is cut into blocks of about ``block`` of them, and every two blocks meet under a key of their own, so no report is
    one task; common reports are counted map-side before the shuffle by pair.
    """
    n = fixed.groupBy("method_id").agg(F.count("*").alias("n"))
    sizes = fixed.groupBy("bug_id").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    cut = fixed.join(sizes, "bug_id").select("bug_id", "method_id", "_blocks", F.pmod(F.xxhash64("method_id"), F.col("_blocks")).cast("int").alias("_own"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = cut.select("bug_id", F.col("method_id").alias("method1"), F.col("_own").alias("_i"), every.alias("_j"))
    right = cut.select("bug_id", F.col("method_id").alias("method2"), every.alias("_i"), F.col("_own").alias("_j"))
    common = left.join(right, ["bug_id", "_i", "_j"]).where("method1 < method2").groupBy("method1", "method2").agg(F.count("*").alias("c"))
    return _jaccard(common, "method1", "method2", n, "method_id", "sim_score")


def report_links(fixed: DataFrame, of: DataFrame, block: int = 1000) -> DataFrame:
    """(node, neighbour, sim) of stored (bug_id, method_id): all reports that share a method with each report of ``of`` (node), with the Jaccard
    score of their method sets.

    Both directions are there. A method of many reports is cut into blocks of about ``block``, so it is no hot key.
    """
    n = fixed.groupBy("bug_id").agg(F.count("*").alias("n"))
    blocks = fixed.groupBy("method_id").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    cut = fixed.join(blocks, "method_id")
    near = cut.select("method_id", F.col("bug_id").alias("neighbour"), F.pmod(F.xxhash64("bug_id"), F.col("_blocks")).cast("int").alias("_block"))
    own = cut.withColumnRenamed("bug_id", "node").join(of.select("node").distinct(), "node", "left_semi").select("method_id", "node", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    common = own.join(near, ["method_id", "_block"]).where("node <> neighbour").groupBy("node", "neighbour").agg(F.count("*").alias("c"))
    return _jaccard(common, "node", "neighbour", n, "bug_id", "sim")


def candidates(reports: DataFrame, positives: DataFrame, methods: DataFrame, k: int | None = 300, buckets: int = 4096) -> DataFrame:
    """(bug_id, method_id, label): each report's true methods (1) and ``k`` other ones (0), all other ones if ``k`` is None or there are no more.

    ``reports``: (bug_id), a stated set; ``positives``: (bug_id, method_id); ``methods``: (method_id), each once. Reports without a true method
    are left out. All methods stand in the order of a hash, as in a circle; a report takes those from the place on that its own hash
    names. Methods are joined by place, so a report's candidates come from many tasks, and there is no cross join.
    """
    true = positives.join(reports.select("bug_id").distinct(), "bug_id", "left_semi").select("bug_id", "method_id").join(methods, "method_id", "left_semi").distinct()
    h = hash_number(F.lit("place"), F.col("method_id"))
    at = methods.select("method_id", F.pmod(h, F.lit(buckets)).alias("_bucket"), h.alias("_h"))
    n = at.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = n.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))  # one row per bucket
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", "method_id"))
    placed = at.withColumn("_own", own).join(before, "_bucket").select("method_id", (F.col("_before") + F.col("_own") - 1).alias("_place"))
    total = methods.count()
    asked = true.groupBy("bug_id").agg(F.count("*").alias("_true")).withColumn("_from", F.pmod(hash_number(F.lit("from"), F.col("bug_id")), F.lit(max(total, 1))))
    many = F.lit(total) if k is None else F.least(F.lit(total), F.col("_true") + k)
    steps = asked.where(many > 0).select("bug_id", "_from", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)).alias("_step"))
    met = steps.select("bug_id", "_step", F.pmod(F.col("_from") + F.col("_step"), F.lit(max(total, 1))).alias("_place")).join(placed, "_place")
    other = met.join(true, ["bug_id", "method_id"], "left_anti")
    if k is not None:  # a few more were taken than asked for, in place of the true ones
        other = other.withColumn("_r", F.row_number().over(Window.partitionBy("bug_id").orderBy("_step"))).where(F.col("_r") <= k)
    return true.select("bug_id", "method_id", F.lit(1).alias("label")).unionByName(other.select("bug_id", "method_id", F.lit(0).alias("label")))


def candidate_history(asked: DataFrame, fixes: DataFrame) -> DataFrame:
    """``asked`` (bug_id, method_id, at, train, ...) with bff and bfr: how many strictly earlier reports fixed the method, and
    ``1 / (months since the latest of them + 1)``; 0 without any. For any method, whether the report fixed it or not.

    ``fixes``: (bug_id, method_id, at, train). Training reports see training reports only, others see all. The window of a method holds one row
    per time at which it was fixed or is asked for.
    """
    count = lambda c: F.count_distinct(c)
    own = fixes.groupBy("method_id", "at").agg(count("bug_id").alias("n"), count(F.when(F.col("train"), F.col("bug_id"))).alias("n_train"))
    zero = F.lit(0).cast("bigint")
    times = own.unionByName(asked.select("method_id", "at", zero.alias("n"), zero.alias("n_train")).distinct()).groupBy("method_id", "at").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))
    w = Window.partitionBy("method_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = times.select("method_id", "at", *[x for c in ("n", "n_train") for x in (F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_{c}"), F.max(F.when(F.col(c) > 0, F.col("at"))).over(w).alias(f"_at_{c}"))])
    both = asked.join(seen, ["method_id", "at"])
    latest = F.when(F.col("train"), F.col("_at_n_train")).otherwise(F.col("_at_n"))
    bff = F.when(F.col("train"), F.col("_n_train")).otherwise(F.col("_n"))
    return both.select(*asked.columns, bff.alias("bff"), F.coalesce(1.0 / (month_distance(F.col("at"), latest) + 1), F.lit(0.0)).alias("bfr"))


def expansion(similar: DataFrame, scored: DataFrame, calls: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(method_id, neighbour), once each: the ``k`` best neighbours of every method by similarity (method1, method2, sim_score), by call
    score (id1, id2, call_score), and the first ``k`` of the call graph (src, dst); all undirected, ties by the greater id, in the call graph
    the lesser first. Null and NaN scores and loops don't count; of repeated pairs the greatest score does."""

    def best(df: DataFrame, a: str, b: str, score: str) -> DataFrame:
        usable = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & (F.col(a) != F.col(b)))
        both = undirected(usable, a, b, score).groupBy("node", "neighbour").agg(F.max(score).alias("score"))
        return top_scores(both.select(F.col("node").alias("query"), F.col("neighbour").alias("node"), "score"), k).select(F.col("query").alias("method_id"), F.col("node").alias("neighbour"))

    out = best(similar, "method1", "method2", "sim_score").unionByName(best(scored, "id1", "id2", "call_score"))
    if calls is not None:
        w = Window.partitionBy("method_id").orderBy("neighbour")
        near = undirected(calls.where("src <> dst"), "src", "dst").distinct().withColumnRenamed("node", "method_id")
        out = out.unionByName(near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("method_id", "neighbour"))
    return out.distinct()


#: Fixes that are broadcast; each takes about 8 bytes.
LOCAL_FIXES = 8_000_000


def _lists(key: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of each key begin, and the values by key."""
    order = np.argsort(key, kind="stable")
    return np.searchsorted(key[order], np.arange(n + 1)).astype(np.int32), value[order].astype(np.int32)


def _expand(lists: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``keys``, by its place, all its values."""
    start, values = lists
    size = start[keys + 1] - start[keys]
    at = np.repeat(start[keys] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.repeat(np.arange(len(keys)), size), values[at]


def _linked(keys: np.ndarray, there: tuple, back: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, neighbour, sim / degree) of ``keys``: all others with a common value, by the Jaccard score of their value sets."""
    n = len(there[0]) - 1
    size = lambda of: there[0][of + 1] - there[0][of]
    place, value = _expand(there, keys)
    i, other = _expand(back, value)
    code, c = np.unique(place[i] * n + other, return_counts=True)
    place, other = code // n, code % n
    mine = keys[place]
    apart = mine != other
    place, other, mine, c = place[apart], other[apart], mine[apart], c[apart]
    return place, other, c / (size(mine) + size(other) - c) / np.bincount(place, minlength=len(keys))[place]


def _summed(query: np.ndarray, item: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, at = np.unique(query * n + item, return_inverse=True)
    return code // n, code % n, np.bincount(at, score, len(code))


def share_fixes(fixes: DataFrame):
    """Broadcast: report ids in order, their times, method ids in order, methods of reports, reports of methods."""
    all_ = fixes.select(F.col("bug_id").cast("bigint"), F.col("method_id").cast("bigint"), micros(F.col("at")).alias("at")).toArrow()
    bug, method, at = (c.to_numpy() for c in all_.columns)
    bugs, first, b = np.unique(bug, return_index=True, return_inverse=True)
    methods, m = np.unique(method, return_inverse=True)
    return fixes.sparkSession.sparkContext.broadcast((bugs, at[first], methods, _lists(b, m, len(bugs)), _lists(m, b, len(methods))))


def _places(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``ids`` among the sorted ids ``of``, and which are there."""
    place = np.minimum(np.searchsorted(of, ids), max(len(of) - 1, 0))
    return place, of[place] == ids if len(of) else np.zeros(len(ids), bool)


def _dense_scores(shared: tuple, asked: np.ndarray, seeds: tuple, k: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ``chunk`` of the ``asked`` reports (numbers) at a time these and their collaborative scores of all methods; ``seeds``: ids of query and
    node, score."""
    bugs, at, methods, of_bug, of_method = shared
    (q, known_q), (n, known_n), score = _places(seeds[0], bugs), _places(seeds[1], bugs), seeds[2]
    good = known_q & known_n
    good[good] = at[n[good]] < at[q[good]]

    def best(q: np.ndarray, n: np.ndarray, score: np.ndarray) -> tuple:
        order = np.lexsort((-n, -score, q))  # numbers of reports stand in the order of their ids
        q = q[order]
        top = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        return q[top], n[order][top], score[order][top]

    q, n, score = best(q[good], n[good], score[good])
    for i in range(0, len(asked), chunk):
        these = asked[i : i + chunk]
        rows = np.concatenate([np.arange(*np.searchsorted(q, [x, x + 1])) for x in these])
        qs, ns, ss = np.repeat(np.arange(len(these)), [np.searchsorted(q, x, "right") - np.searchsorted(q, x) for x in these]), n[rows], score[rows]
        nodes, at_node = np.unique(ns, return_inverse=True)
        place, other, part = _linked(nodes, of_bug, of_method)
        row, link = _expand((np.searchsorted(place, np.arange(len(nodes) + 1)), np.arange(len(place))), at_node)
        mq, mn, ms = _summed(qs[row], other[link], part[link], len(bugs))
        late = at[mn] < at[these[mq]]
        mq, mn, ms = best(mq[late], mn[late], np.round(ms[late], 12))
        rq, rn, rs = _summed(np.concatenate([qs, mq]), np.concatenate([ns, mn]), np.concatenate([ss, ms]), len(bugs))
        row, own = _expand(of_bug, rn)
        fq, fm, fs = _summed(rq[row], own, rs[row] / np.diff(of_bug[0])[rn[row]], len(methods))
        scored, at_method = np.unique(fm, return_inverse=True)
        place, other, part = _linked(scored, of_method, of_bug)
        row, link = _expand((np.searchsorted(place, np.arange(len(scored) + 1)), np.arange(len(place))), at_method)
        cell = np.concatenate([fq * len(methods) + fm, fq[row] * len(methods) + other[link]])
        yield these, np.bincount(cell, np.concatenate([fs, part[link]]), len(these) * len(methods)).reshape(len(these), -1)


def _together(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    held = [x for x in batches if x.num_rows]
    return [c.to_numpy() for c in pa.Table.from_batches(held).columns] if held else None


def local_scores(shared, seeds: DataFrame, wanted: DataFrame, k: int = 50, chunk: int = 8) -> DataFrame:
    """The ``candidate_scores`` of ``wanted`` (bug_id, method_id), by following links in the broadcast fixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bugs, methods = shared.value[0], shared.value[2]
        columns = _together(batches)
        if columns is None or not len(bugs):
            return
        query, node, score, seed = columns
        (q, known_q), (m, known_m) = _places(query, bugs), _places(node, methods)
        own = np.flatnonzero(~seed & known_q & known_m)
        own = own[np.argsort(q[own], kind="stable")]
        for these, dense in _dense_scores(shared.value, np.unique(q[own]), tuple(c[seed] for c in (query, node, score)), k, chunk):
            for x, scores in zip(these, dense):
                mine = own[np.searchsorted(q[own], x) : np.searchsorted(q[own], x, "right")]
                mine = mine[scores[m[mine]] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (query[mine], node[mine], scores[m[mine]])], names=["bug_id", "method_id", "cfs"])

    rows = _seed_rows(seeds).unionByName(wanted.select(F.col("bug_id").cast("bigint").alias("query"), F.col("method_id").cast("bigint").alias("node"), F.lit(0.0).alias("score"), F.lit(False).alias("seed")))
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query").mapInArrow(run, "bug_id bigint, method_id bigint, cfs double")


def _seed_rows(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.col("query").cast("bigint").alias("query"), F.col("node").cast("bigint").alias("node"), F.col("score").cast("double").alias("score"), F.lit(True).alias("seed"))


def candidate_scores(fixes: DataFrame, seeds: DataFrame, similar: DataFrame, k: int = 50) -> DataFrame:
    """(bug_id, method_id, cfs): the collaborative scores from strictly earlier reports.

    ``fixes``: stored (bug_id, method_id, at, train); ``seeds``: (query, node, score), the earlier reports most like each report; ``similar``:
    ``method_links`` of the fixes. By joins, for any number of fixes; ``local_scores`` and ``local_candidates`` broadcast them.
    """
    times = fixes.select(F.col("bug_id").alias("node"), "at").distinct()
    links = materialize(report_links(fixes.select("bug_id", "method_id"), seeds), "links")
    both = materialize(undirected(similar.withColumnRenamed("sim_score", "sim"), "method1", "method2", "sim"), "similar")
    return collaborative(seeds, links, fixes.select(F.col("bug_id").alias("node"), "method_id"), both, k, times).select(F.col("query").alias("bug_id"), "method_id", "cfs")


def code_features(methods: DataFrame, expanded: DataFrame, code: DataFrame) -> DataFrame:
    """(method_id, has_code, n_expand) of each method: whether it has code, and how many of its neighbours (``expansion``) have; ``code``:
    (method_id), a row per method with exactly one piece of code."""
    near = expanded.join(code.select(F.col("method_id").alias("neighbour")), "neighbour").groupBy("method_id").agg(F.count("*").alias("_near"))
    wide = methods.join(code.select("method_id", F.lit(True).alias("_code")), "method_id", "left").join(near, "method_id", "left")
    return wide.select("method_id", F.coalesce("_code", F.lit(False)).alias("has_code"), F.coalesce("_near", F.lit(0)).alias("n_expand"))


def prepared(asked: DataFrame, fixes: DataFrame, cfs: DataFrame, known: DataFrame) -> DataFrame:
    """(bug_id, method_id, label, train, bff, bfr, cfs, has_code, n_expand) of candidates (bug_id, method_id, label, at, train).

    ``fixes``: stored (bug_id, method_id, at, train); ``cfs``: ``candidate_scores``, 0 where there is none; ``known``: ``code_features``.
    """
    wide = candidate_history(asked, fixes).join(cfs, ["bug_id", "method_id"], "left").join(known, "method_id", "left")
    return wide.select("bug_id", "method_id", "label", "train", "bff", "bfr", F.coalesce("cfs", F.lit(0.0)).alias("cfs"), F.coalesce("has_code", F.lit(False)).alias("has_code"), F.coalesce("n_expand", F.lit(0)).alias("n_expand"))


#: Columns of ``every_candidate``.
EVERY = "bug_id bigint, method_id bigint, label int, train boolean, bff bigint, bfr double, cfs double, has_code boolean, n_expand bigint"


def _whole(bug: int, method: np.ndarray, label: np.ndarray, *rest: np.ndarray) -> list:
    return [np.full(len(method), bug), method, label, np.zeros(len(method), bool), *rest]


def _recency(n: int, digits: int | None) -> np.ndarray:
    """1 / (months + 1) of 0 to n - 1 months; rounded half up as in SQL."""
    exact = [1.0 / (i + 1) for i in range(n)]
    return np.array(exact if digits is None else [float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in exact])


def every_candidate(asked: DataFrame, fixes: DataFrame, cfs: DataFrame, known: DataFrame, digits: int | None = None, then: Callable = _whole, schema: str = EVERY) -> DataFrame:
    """The rows of ``prepared`` for all methods as candidates of each test report: reports times methods.

    ``asked``: (bug_id, at), a stated set of reports, of which those with a true method count; ``fixes``: (bug_id, method_id, at), of which all
    strictly earlier ones are seen; ``cfs``: ``candidate_scores``; ``known``: ``code_features`` of all methods. With ``digits`` bfr is rounded.

    Only what differs from nothing is shuffled, by method: a task holds the fixes and scores of its methods, passes through the reports
    in order of time and makes all candidates of a report at once. ``then`` gets report, methods, label, bff, bfr, cfs, has_code and
    n_expand and makes the columns of ``schema``, or None, so that what follows needs no row per candidate.
    """
    spark = known.sparkSession
    month = (F.year("at") * 12 + F.month("at")).cast("bigint")
    usable = fixes.join(known.select("method_id"), "method_id", "left_semi")
    q = asked.join(usable.select("bug_id"), "bug_id", "left_semi").select("bug_id", micros(F.col("at")).alias("at"), month.alias("month")).distinct().orderBy("at", "bug_id").collect()
    reports = spark.sparkContext.broadcast([np.array([r[i] for r in q], dtype=np.int64) for i in range(3)])
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    bug = F.col("bug_id").cast("bigint").alias("bug_id")
    rows = known.select(F.col("method_id").cast("bigint"), F.lit(0).alias("kind"), zero.alias("bug_id"), F.col("n_expand").cast("bigint").alias("at"), F.col("has_code").cast("bigint").alias("month"), none.alias("value"))
    rows = rows.unionByName(fixes.select(F.col("method_id").cast("bigint"), F.lit(1).alias("kind"), bug, micros(F.col("at")).alias("at"), month.alias("month"), none.alias("value")).distinct())
    rows = rows.unionByName(cfs.join(asked.select("bug_id").distinct(), "bug_id", "left_semi").select(F.col("method_id").cast("bigint"), F.lit(2).alias("kind"), bug, zero.alias("at"), zero.alias("month"), F.col("cfs").alias("value")))
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bugs, ats, months = reports.value
        held = [b for b in batches if b.num_rows]
        if not held or not len(bugs):
            return
        method, kind, bug, at, month, value = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        held.clear()
        own = kind == 0
        order = np.argsort(method[own])
        methods, n_expand, has_code = (c[own][order] for c in (method, at, month))
        if not len(methods):
            return
        has_code = has_code > 0
        place = np.searchsorted(methods, method)
        there = methods[np.minimum(place, len(methods) - 1)] == method
        by_bug = np.argsort(bugs)

        def of_reports(mine: np.ndarray) -> tuple:
            """Rows of the asked reports, ordered by the report's number, and where each report's begin."""
            found = np.minimum(np.searchsorted(bugs, bug[mine], sorter=by_bug), len(bugs) - 1)
            number = by_bug[found]
            ours, number = mine[bugs[number] == bug[mine]], number[bugs[number] == bug[mine]]
            order = np.argsort(number, kind="stable")
            return ours[order], np.searchsorted(number[order], np.arange(len(bugs) + 1))

        fixed = np.flatnonzero((kind == 1) & there)
        true, true_at = of_reports(fixed)
        scored, scored_at = of_reports(np.flatnonzero((kind == 2) & there))
        fixed = fixed[np.argsort(at[fixed], kind="stable")]
        seen = np.searchsorted(at[fixed], ats, "left")  # strictly earlier fixes of each report
        span = max(1, int(months.max() - min(months.min(), month[fixed].min(initial=months.max()))) + 1)
        recency = _recency(span, digits)
        bff, latest, upto = np.zeros(len(methods), np.int64), np.zeros(len(methods), np.int64), 0
        for i, this in enumerate(bugs):
            new, upto = fixed[upto : seen[i]], max(upto, seen[i])
            np.add.at(bff, place[new], 1)
            np.maximum.at(latest, place[new], month[new])
            label, score = np.zeros(len(methods), np.int32), np.zeros(len(methods))
            label[place[true[true_at[i] : true_at[i + 1]]]] = 1
            mine = scored[scored_at[i] : scored_at[i + 1]]
            score[place[mine]] = value[mine]
            bfr = np.where(bff > 0, recency[np.where(bff > 0, months[i] - latest, 0)], 0.0)
            out = then(this, methods, label, bff, bfr, score, has_code, n_expand)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // 50_000))
    return rows.repartition(parts, "method_id").mapInArrow(run, schema)


def local_candidates(shared, asked: DataFrame, seeds: DataFrame, known: DataFrame, digits: int | None = None, then: Callable = _whole, schema: str = EVERY, k: int = 50, chunk: int = 8) -> DataFrame:
    """The rows of ``every_candidate`` with the fixes and all methods broadcast: a task holds some of the reports, in order of time, and follows
    their links itself, so that only the seeds are shuffled. With ``digits`` bfr and cfs are rounded."""
    table = known.select(F.col("method_id").cast("bigint"), "has_code", F.col("n_expand").cast("bigint")).orderBy("method_id").toArrow()
    every = known.sparkSession.sparkContext.broadcast(tuple(c.to_numpy() for c in table.columns))
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bugs, at, fixed, of_bug, of_method = shared.value
        methods, has_code, n_expand = every.value
        columns = _together(batches)
        if columns is None or not len(bugs):
            return
        query, node, score, seed = columns
        q, there = _places(query, bugs)
        asked = np.unique(q[~seed & there])
        asked = asked[np.argsort(at[asked], kind="stable")]
        place, usable = _places(fixed, methods)
        by_time = np.argsort(at, kind="stable")
        month = at.astype("datetime64[us]").astype("datetime64[M]").astype(np.int64)
        recency = _recency(int(month.max() - month.min()) + 1, digits)
        bff, latest, upto = np.zeros(len(fixed), np.int64), np.full(len(fixed), month.min()), 0
        for these, dense in _dense_scores(shared.value, asked, tuple(c[seed] for c in (query, node, score)), k, chunk):
            for x, scores in zip(these, dense):
                until = np.searchsorted(at[by_time], at[x])
                row, m = _expand(of_bug, by_time[upto:until])
                np.add.at(bff, m, 1)
                np.maximum.at(latest, m, month[by_time[upto:until]][row])
                upto = until
                own = of_bug[1][of_bug[0][x] : of_bug[0][x + 1]]
                own = place[own[usable[own]]]
                if not len(own):
                    continue
                label, bffs, bfr, cfs = (np.zeros(len(methods), t) for t in (np.int32, np.int64, float, float))
                label[own] = 1
                if digits is not None:
                    scores = np.floor((scores + 1e-9) * 10**digits + 0.5) / 10**digits  # as candidate scores are rounded elsewhere
                bffs[place[usable]], cfs[place[usable]] = bff[usable], scores[usable]
                bfr[place[usable]] = np.where(bff > 0, recency[month[x] - latest], 0.0)[usable]
                out = then(bugs[x], methods, label, bffs, bfr, cfs, has_code, n_expand)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    ids = asked.select(F.col("bug_id").cast("bigint").alias("query")).distinct()
    rows = _seed_rows(seeds).join(ids, "query", "left_semi").unionByName(ids.select("query", F.lit(0).cast("bigint").alias("node"), F.lit(0.0).alias("score"), F.lit(False).alias("seed")))
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query").mapInArrow(run, schema)
