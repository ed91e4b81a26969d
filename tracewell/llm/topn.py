"""Top N items within every group, however large the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A group is heavy from this many rows on, whatever the size of the table.
HEAVY_ROWS = 50_000
#: Heavy groups that are broadcast at most; beyond that they are joined through salts.
BROADCAST_GROUPS = 100_000
_SALTS = 32


def heavy_groups(df: DataFrame, group: list[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The groups with at least ``heavy_rows`` rows, by exact counts; every other group is small enough for one task."""
    counts = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") >= heavy_rows)
    return materialize(counts.dropna(subset=group).select(*group), "heavy")


def join_heavy(df: DataFrame, heavy: DataFrame, group: list[str], how: str, limit: int = BROADCAST_GROUPS) -> DataFrame:
    """``df`` joined with one row per heavy group (``heavy``, stored): left, semi or anti.

    Up to ``limit`` heavy groups are broadcast. More are joined by (group, salt), every heavy group standing in all salts, so that no group
    with many rows is one key.
    """
    if heavy.count() <= limit:
        return df.join(F.broadcast(heavy), group, how)
    salted = heavy.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int"))
    return dealt.join(salted, [*group, "_salt"], how).drop("_salt")


def split_heavy(df: DataFrame, group: list[str], heavy_rows: int = HEAVY_ROWS, limit: int = BROADCAST_GROUPS) -> tuple[DataFrame, DataFrame]:
    """(rows of heavy groups, rows of light groups). Rows with a null group count as light."""
    heavy = heavy_groups(df, group, heavy_rows)
    return join_heavy(df, heavy, group, "left_semi", limit), join_heavy(df, heavy, group, "left_anti", limit)


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rnk", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, numbered from 1 in column ``rank``.

    ``order`` must end in columns that tell a group's rows apart; rows equal in all of it come in any order. Null groups form one
    group, as in a window; other columns pass through, nulls included.
    ``df`` is read several times and should be a stored table.

    Light groups go through an ordinary window. Rows of heavy groups are sorted by range over (group, order), so that a
    group lies in as many salts (sorted ranges) as its size asks for; each salt keeps its first ``n``, and a second
    window picks among those.
    """
    if rank in df.columns:
        raise ValueError(f"the input has a column {rank} already")
    heavy, light = split_heavy(df, group, heavy_rows)
    first = light.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
    salted = heavy.repartitionByRange(*[F.col(g).asc() for g in group], *order).withColumn("_salt", F.spark_partition_id())
    local = Window.partitionBy(*group, "_salt").orderBy(*order)
    kept = salted.withColumn("_place", F.row_number().over(local)).where(F.col("_place") <= n).drop("_place", "_salt")
    last = kept.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
    return first.unionByName(last)
