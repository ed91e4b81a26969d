"""Issue events as a stream (an extension: the batch operators serve one event at a time as well)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shred import issue_events


def is_bug(labels: Column) -> Column:
    """Whether the name of any label holds ``bug``."""
    return F.coalesce(F.exists(labels, lambda x: F.contains(x["name"], F.lit("bug"))), F.lit(False))


def title_commit(title: Column) -> Column:
    """The commit that the last ``&`` part of a title names as ``commitId:<sha>``; null if it names none."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(title, "&"), -1), r"^\s*commitId:\s*([0-9A-Za-z]+)\s*$", 1), F.lit(""))


def result_rows(df: DataFrame, column: str) -> DataFrame:
    """(place, uri, probability) of a result string ``[('uri', p), ...]``; commas inside a signature don't separate."""
    shape = r"\(\s*'([^']*)'\s*,\s*([0-9.eE+-]+)\s*\)"
    uris, ps = (F.regexp_extract_all(column, F.lit(shape), F.lit(i)) for i in (1, 2))
    zipped = df.select("*", F.posexplode(F.arrays_zip(uris.alias("uri"), ps.alias("p"))).alias("place", "_z"))
    return zipped.select(*df.columns, "place", F.col("_z.uri").alias("uri"), F.col("_z.p").try_cast("double").alias("probability"))


def opened_bugs(events: DataFrame, pinned: dict[str, str] | None = None) -> DataFrame:
    """(repo, number, title, body, commit) of opened issues with a bug label: the commit is the pinned one of the project, else the title's.

    Of every event of a payload (hook_id, payload), arrays and wrappers included.
    """
    e = issue_events(events, "hook_id", "payload").where((F.col("action") == "opened") & is_bug(F.col("labels")))
    pin = F.create_map(*[F.lit(x) for kv in (pinned or {"": ""}).items() for x in kv])
    return e.select("repo", "number", "title", "body", F.coalesce(F.try_element_at(pin, F.col("repo")), title_commit(F.col("title"))).alias("commit"))


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Start a query over Parquet files of (hook_id, delivered_at, payload) that arrive in a folder; ``handle`` gets each batch of opened bugs.

    Deliveries repeated within a day are handled once (keyed state, dropped behind the watermark).
    """
    stream = spark.readStream.schema("hook_id bigint, delivered_at timestamp, payload string").parquet(folder)
    once = stream.withWatermark("delivered_at", "1 day").dropDuplicatesWithinWatermark(["hook_id"])
    return opened_bugs(once).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
