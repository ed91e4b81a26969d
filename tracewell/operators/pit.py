"""Attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Width of a time bucket for entities with few changes, in microseconds (two years).
BASE_WIDTH = 2 * 365 * 86_400_000_000
#: Changes an entity may have, on average, in a bucket before its buckets are halved.
PER_BUCKET = 16
#: A join key is hot if it holds more than one in HOT_SHARE of all events, so there are fewer than HOT_SHARE hot keys in any table.
HOT_SHARE = 1000


def _bucket(t: Column, width: Column) -> Column:
    return ((t - F.pmod(t, width)) / width).cast("bigint")


def validity(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """Half-open validity intervals, cut at time buckets, of the best state known at each time.

    ``changes`` has (entity, known, state, width): from ``known`` (microseconds) on, ``state`` (a struct whose
    order says which of two states wins) can be used; ``width`` is the entity's bucket width. ``asked`` has the
    (entity, width, bucket) in which events lie, once each. The result has (entity, bucket, since, till, state), one row per interval and
    bucket. A state that became known late opens its interval when it became known and never reaches back.

    An interval without change is repeated only for the buckets that events ask for, so the rows are bounded by changes and events together,
    however far apart in time they lie. The running best inside a bucket and the best of the buckets before it are found apart, so
    the window over an entity holds one row per bucket, never one per change.
    """
    placed = changes.withColumn("bucket", _bucket(F.col("known"), F.col("width")))
    nothing = F.lit(None).cast(changes.schema["state"].dataType)
    per_bucket = placed.select("entity", "width", "bucket", F.col("state").alias("top")).unionByName(asked.select("entity", "width", "bucket", nothing.alias("top")))
    by_entity = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = per_bucket.groupBy("entity", "width", "bucket").agg(F.max("top").alias("top"))
    carried = tops.select("entity", "width", "bucket", "top", F.max("top").over(by_entity).alias("before")).where("before is not null")
    since = F.col("bucket") * F.col("width")
    filled = carried.where("top is null").select("entity", "bucket", since.alias("since"), (since + F.col("width")).alias("till"), F.col("before").alias("state"))
    # the carried state enters its bucket as a change at the bucket's start; real changes at the same time win or lose by order
    entering = carried.where("top is not null").select("entity", "width", "bucket", since.alias("known"), F.col("before").alias("state"))
    entries = placed.select("entity", "width", "bucket", "known", "state").unionByName(entering)
    inside = Window.partitionBy("entity", "bucket").orderBy("known")
    changed = entries.select(
        "entity",
        "bucket",
        F.col("known").alias("since"),
        F.coalesce(F.lead("known").over(inside), since + F.col("width")).alias("till"),
        F.max("state").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("state"),
    )
    return changed.where("since < till").unionByName(filled)


def _bucketed(events: DataFrame, busy: DataFrame, base_width: int, hot: int) -> DataFrame:
    """``events`` with the bucket width of their entity and their bucket; entities with a great share of the events get theirs by broadcast."""
    often = F.broadcast(events.groupBy("entity").count().where(F.col("count") > hot).select("entity"))  # fewer than HOT_SHARE rows
    width = busy.select("entity", F.col("width").alias("_width"))
    most = events.join(often, "entity", "left_semi").join(F.broadcast(width.join(often, "entity", "left_semi")), "entity", "left")
    rest = events.join(often, "entity", "left_anti").join(width, "entity", "left")
    both = most.unionByName(rest).withColumn("_width", F.coalesce("_width", F.lit(base_width).cast("bigint")))
    return both.withColumn("_bucket", _bucket(F.col("at"), F.col("_width")))


def known_at(events: DataFrame, changes: DataFrame, how: str = "inner", base_width: int = BASE_WIDTH, per_bucket: int = PER_BUCKET, hot_share: int = HOT_SHARE) -> DataFrame:
    """Each event with the best state of its entity that was known at the event's time.

    ``events``: (entity, at, anything else), a stored table; ``changes``: (entity, known, state). ``at`` and ``known`` are
    microseconds. An event matches if
    ``known <= at``; of several states the greatest wins. Changes with a null entity, time or state are left out,
    and so are events with a null entity or time (``how="left"`` keeps those, with a null state). Repeated
    changes count once, repeated events each. Columns of both inputs may share names other than these three.

    Validity intervals are exploded into time buckets and equi-joined with the events by entity and bucket, with
    half-open containment. An entity with many changes gets narrower buckets, so that a bucket holds about
    ``per_bucket`` changes; cost stays linear in the rows. An (entity, bucket) with more than one in ``hot_share`` of the events is
    salted: its events are dealt to so many salts that none holds more, and its few intervals are repeated for each.
    """
    usable = changes.select("entity", "known", "state").dropna().groupBy("entity", "known").agg(F.max("state").alias("state"))
    n = usable.groupBy("entity").count()
    level = F.ceil(F.log2(F.col("count") / per_bucket)).cast("int")
    busy = n.where(F.col("count") > per_bucket).select("entity", F.expr(f"{base_width}L").alias("_base"), level.alias("_level"))
    busy = busy.select("entity", F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_base") / F.pow(F.lit(2.0), F.col("_level"))).cast("bigint")).alias("width"))
    hot = events.count() // hot_share
    keyed = materialize(_bucketed(events, busy, base_width, hot), "events")
    asked = keyed.dropna(subset=["entity", "_bucket"]).groupBy("entity", F.col("_width").alias("width"), F.col("_bucket").alias("bucket")).count()
    salts = F.broadcast(asked.where(F.col("count") > hot).select("entity", "bucket", F.ceil(F.col("count") / max(hot, 1)).cast("int").alias("_salts")))  # fewer than hot_share rows
    wide = F.coalesce(F.col("width"), F.lit(base_width).cast("bigint"))
    intervals = validity(usable.join(busy, "entity", "left").withColumn("width", wide), asked.select("entity", "width", "bucket"))
    right = intervals.join(salts, ["entity", "bucket"], "left").withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    right = right.select(F.col("entity").alias("_entity"), F.col("bucket").alias("_bucket_r"), F.col("since").alias("_since"), F.col("till").alias("_till"), "state", "_salt_r")
    dealt = keyed.join(salts.withColumnRenamed("bucket", "_bucket"), ["entity", "_bucket"], "left")
    left = dealt.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))).cast("int"))  # the same again for a stored table
    on = (left["entity"] == right["_entity"]) & (left["_bucket"] == right["_bucket_r"]) & (left["_salt"] == right["_salt_r"])
    found = left.join(right, on & (right["_since"] <= left["at"]) & (left["at"] < right["_till"]), how)
    return found.select(*events.columns, "state")
