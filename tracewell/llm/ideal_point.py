"""One ranking from several differently-scaled scores, by relative closeness to an ideal point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import range_sums
from ..session import materialize
from .topn import BROADCAST_GROUPS, HEAVY_ROWS, heavy_groups, join_heavy


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _usable(score: str) -> Column:
    c = F.col(score).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (c >= 0), c + 0.0)


def _melted(heavy: DataFrame, group: str, item: str | None, n: int) -> DataFrame:
    return heavy.select(group, *([item] if item else []), F.posexplode(F.array(*[f"_s{i}" for i in range(n)])).alias("_k", "_v"))


def _before(heavy: DataFrame, group: str, n: int, descending: bool) -> DataFrame:
    """(group, _k, _v, _c, _before): each distinct value of each score with its rows and the rows before it."""
    values = _melted(heavy, group, None, n).where("_v is not null").groupBy(group, "_k", "_v").agg(F.count("*").alias("_c"))
    return range_sums(values, [group, "_k"], [F.col("_v").desc() if descending else F.col("_v").asc()], {"_before": "_c"})


def places(df: DataFrame, group: str, item: str, scores: list[str], heavy_rows: int = HEAVY_ROWS, limit: int = BROADCAST_GROUPS) -> DataFrame:
    """(group, item, _n, _p0, _p1, ...): each item's place by each score, 1 + the number of strictly greater values.

    Missing values (null, NaN, negative) are not counted and get place ``_n`` + 1, ``_n`` being the group's rows.
    Heavy groups are ranked over their distinct values, with counts, by range.
    """
    clean = df.select(group, item, *[_usable(s).alias(f"_s{i}") for i, s in enumerate(scores)])
    names = heavy_groups(clean, [group], heavy_rows)
    heavy, light = (join_heavy(clean, names, [group], how, limit) for how in ("left_semi", "left_anti"))
    whole = Window.partitionBy(group)
    ranks = [F.rank().over(whole.orderBy(F.col(f"_s{i}").desc_nulls_last())).alias(f"_r{i}") for i in range(len(scores))]
    ranked = light.select("*", F.count("*").over(whole).alias("_n"), *ranks)  # a light group has fewer than heavy_rows rows
    own = [F.when(F.col(f"_s{i}").isNull(), F.col("_n") + 1).otherwise(F.col(f"_r{i}")).cast("bigint").alias(f"_p{i}") for i in range(len(scores))]
    first = ranked.select(group, item, "_n", *own)
    placed = _before(heavy, group, len(scores), True).select(group, "_k", "_v", (F.col("_before") + 1).alias("_p"))
    sizes = materialize(heavy.groupBy(group).agg(F.count("*").alias("_n")), "sizes")
    joined = join_heavy(_melted(heavy, group, item, len(scores)).join(placed, [group, "_k", "_v"], "left"), sizes, [group], "inner", limit)
    place = F.coalesce(F.col("_p"), F.col("_n") + 1)
    wide = joined.groupBy(group, item, "_n").agg(*[F.max(F.when(F.col("_k") == i, place)).alias(f"_p{i}") for i in range(len(scores))])
    return first.unionByName(wide)


def _bounds(light: DataFrame, heavy: DataFrame, group: str, n: int, winsor: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """(group, _q0, _q1, ...) of light and of heavy groups: exact quantiles (lower, upper) of each score's values.

    The quantile ``q`` of n values is the one at place ``ceil(q * n)`` from below, 1 at least; null without values.
    """
    at = lambda size, q: F.greatest(F.lit(1), F.ceil(size * F.lit(float(q)))).cast("int")
    sorted_ = light.groupBy(group).agg(*[F.array_sort(F.collect_list(f"_s{i}")).alias(f"_v{i}") for i in range(n)])
    own = sorted_.select(group, *[F.array(*[F.try_element_at(f"_v{i}", at(F.size(f"_v{i}"), q)) for q in winsor]).alias(f"_q{i}") for i in range(n)])
    values = _before(heavy, group, n, False)
    sizes = values.groupBy(group, "_k").agg(F.sum("_c").alias("_size"))
    first = [F.min(F.when(F.col("_before") + F.col("_c") >= at(F.col("_size"), q), F.col("_v"))).alias(f"_{j}") for j, q in enumerate(winsor)]
    # one small row per heavy group and score on the right side
    found = values.join(sizes.select(F.col(group).alias("_g"), F.col("_k").alias("_j"), "_size"), (F.col(group) == F.col("_g")) & (F.col("_k") == F.col("_j"))).groupBy(group, "_k").agg(*first)
    none = F.array(*[F.lit(None).cast("double") for _ in winsor])
    wide = found.groupBy(group).agg(*[F.max(F.when(F.col("_k") == i, F.array("_0", "_1"))).alias(f"_q{i}") for i in range(n)])
    every = heavy.select(group).distinct().join(wide, group, "left")
    return own, every.select(group, *[F.coalesce(f"_q{i}", none).alias(f"_q{i}") for i in range(n)])


def closeness(
    df: DataFrame,
    group: str,
    item: str,
    scores: list[str],
    weights: list[float] | None = None,
    scale: str = "vector",
    winsor: tuple[float, float] = (0.01, 0.99),
    heavy_rows: int = HEAVY_ROWS,
    limit: int = BROADCAST_GROUPS,
) -> DataFrame:
    """(group, item, closeness): relative closeness of each item to its group's ideal point, greatest is best.

    ``d- / (d+ + d-)`` with ``d+`` and ``d-`` the weighted distances to the ideal point (the greatest of each scaled
    score in the group) and to the anti-ideal one (the least). Scales:

    - ``vector``: scores winsorised at the exact quantiles ``winsor`` of the group and divided by the group's vector norm;
      Euclidean distances. A missing score (null, NaN, negative) counts as the least of the group.
    - ``place``: a score becomes its place in the group, so its distribution counts for nothing and each score weighs
      the same; city-block distances. Here closeness falls linearly with the weighted sum of places, and is
      exact: equal sums give equal closeness for equal weights. The ideal point is place 1, the anti-ideal one place n + 1.

    (group, item) should be unique; ``df`` is read several times and should be stored. A group in which no score tells items
    apart gets closeness 0.5. Rows with a null group are left out.

    A group with ``heavy_rows`` or more rows never is in one task: its quantiles and places come from sums by range, its norms and extremes from
    partial aggregation, and its rows meet them by broadcast (beyond ``limit`` heavy groups by salted keys).
    """
    w = weights or [1.0] * len(scores)
    known = df.where(F.col(group).isNotNull())
    if scale == "place":
        at = places(known, group, item, scores, heavy_rows, limit)
        far = _sum([F.lit(x) * (F.col("_n") + 1 - F.col(f"_p{i}")) for i, x in enumerate(w)])
        return at.select(group, item, (far / (F.lit(sum(w)) * F.col("_n"))).alias("closeness"))
    clean = known.select(group, item, *[_usable(s).alias(f"_s{i}") for i, s in enumerate(scores)])
    names = heavy_groups(clean, [group], heavy_rows)
    heavy, light = (join_heavy(clean, names, [group], how, limit) for how in ("left_semi", "left_anti"))
    ks = range(len(scores))
    light_bounds, heavy_bounds = _bounds(light, heavy, group, len(scores), winsor)
    cut = [F.coalesce(F.when(F.col(f"_s{i}").isNotNull(), F.greatest(F.least(f"_s{i}", F.col(f"_q{i}")[1]), F.col(f"_q{i}")[0])), F.col(f"_q{i}")[0], F.lit(0.0)).alias(f"_x{i}") for i in ks]
    extremes = [a for i in ks for a in (F.sqrt(F.sum(F.col(f"_x{i}") ** 2)).alias(f"_norm{i}"), F.max(f"_x{i}").alias(f"_hi{i}"), F.min(f"_x{i}").alias(f"_lo{i}"))]
    wins = join_heavy(heavy, materialize(heavy_bounds, "bounds"), [group], "inner", limit).select(group, item, *cut)
    large = join_heavy(wins, materialize(wins.groupBy(group).agg(*extremes), "extremes"), [group], "inner", limit)
    own = light.join(light_bounds, group).select(group, item, *cut)
    both = large.unionByName(own.join(own.groupBy(group).agg(*extremes), group))

    def distance(edge: str) -> Column:
        return F.sqrt(_sum([F.coalesce(F.lit(x) * ((F.col(f"_x{i}") - F.col(f"_{edge}{i}")) / F.nullif(F.col(f"_norm{i}"), F.lit(0.0))) ** 2, F.lit(0.0)) for i, x in enumerate(w)]))

    up, down = distance("hi"), distance("lo")
    return both.select(group, item, F.coalesce(down / F.nullif(up + down, F.lit(0.0)), F.lit(0.5)).alias("closeness"))


def ranking(df: DataFrame, group: str, order: list[Column], rank: str = "rnk", heavy_rows: int = HEAVY_ROWS, limit: int = BROADCAST_GROUPS) -> DataFrame:
    """``df`` (stored, read several times) with each row's place 1, 2, ... in its group by ``order``, which must tell rows apart."""
    names = heavy_groups(df, [group], heavy_rows)
    heavy, light = (join_heavy(df, names, [group], how, limit) for how in ("left_semi", "left_anti"))
    first = light.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))
    last = range_sums(heavy.withColumn("_one", F.lit(1)), [group], order, {"_before": "_one"}).withColumn(rank, F.col("_before") + 1)
    return first.unionByName(last.drop("_one", "_before"))
