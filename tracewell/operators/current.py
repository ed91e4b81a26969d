"""Current rows and resolved method ids of the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.uris import canonical_uri, method_list
from ..session import materialize


def current_rows(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The row of each key with the greatest ``order`` (compared from left to right, nulls least).

    Among rows equal in ``order`` the greatest by the kept columns comes out, so repeated rows give one. Rows with a
    null key are left out. One shuffle; partial aggregation folds repeated keys before it, so no key is hot.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in keys]
    rest = [c for c in keep if c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    known = df.dropna(subset=keys)
    return known.groupBy(*keys).agg(best).select(*keys, *[f"_best.{c}" for c in keep])


def canonical_map(method_map: DataFrame) -> DataFrame:
    """(method_uri, id), stored: the canonical URI of every row of (id, method_uri), so that its pattern runs once for all that need it."""
    named = method_map.select(canonical_uri(F.col("method_uri")).alias("method_uri"), "id").dropna()
    return materialize(named.distinct(), "uris")


def method_ids(canonical: DataFrame) -> DataFrame:
    """(method_uri, method_id): each canonical URI with the smallest id it stands under."""
    return canonical.groupBy("method_uri").agg(F.min("id").alias("method_id"))


def id_aliases(canonical: DataFrame) -> DataFrame:
    """(id, method_id): every id with the smallest id that stands for the same URI."""
    return canonical.join(method_ids(canonical), "method_uri").groupBy("id").agg(F.min("method_id").alias("method_id"))


def report_methods(reports: DataFrame, canonical: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., method_id), once each: the mapped methods (``canonical_map``) that each report's list literal names.

    A popular URI is hot only on the report side of the join, which adaptive execution splits.
    """
    named = reports.select(*keys, F.explode(method_list(F.col("method"))).alias("method_uri"))
    return named.join(method_ids(canonical), "method_uri").select(*keys, "method_id").distinct()
