"""Sums over the rows before each row, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def range_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with a column ``name`` for each (name, weight) of ``sums``: the sum of ``weight`` over the group's rows before this one.

    For groups too large for one task, or none at all: the rows are sorted by range over (group, order) and stored with their range; the
    sums of the ranges before come from one small row per group and range. ``order`` must tell a group's rows apart.
    """
    ranged = materialize(df.repartitionByRange(*[F.col(g).asc() for g in group], *order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.groupBy(*group, "_range").agg(*[F.sum(w).alias(f"_own_{n}") for n, w in sums.items()])
    offset = own.select(*group, "_range", *[F.coalesce(F.sum(f"_own_{n}").over(before), F.lit(0)).alias(f"_offset_{n}") for n in sums])
    local = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *[F.coalesce(F.sum(w).over(local), F.lit(0)).alias(f"_local_{n}") for n, w in sums.items()])
    both = placed.join(offset.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_range").alias("_at"), *[f"_offset_{n}" for n in sums]), _matched(placed, group))
    return both.select(*df.columns, *[(F.col(f"_offset_{n}") + F.col(f"_local_{n}")).alias(n) for n in sums])


def _matched(placed: DataFrame, group: list[str]) -> Column:
    on = F.col("_range") == F.col("_at")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return on
