"""Column functions for report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters read as blanks when a report is cut into tokens.
REPORT_BLANKS = "#!.{};_-[]=(),/\\:*?\"<>|'"


def report_tokens(summary: Column, description: Column) -> Column:
    """Tokens of the summary, then of the description; case is kept. Nulls count as empty text."""
    text = F.concat_ws(" ", summary, description)
    plain = F.translate(text, REPORT_BLANKS, " " * len(REPORT_BLANKS))
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def terms(report: Column) -> Column:
    """Tokens in lower case; a null report or token gives none."""
    return F.transform(F.filter(F.coalesce(report, F.array().cast("array<string>")), lambda w: w.isNotNull()), F.lower)


def clean_time(raw: Column) -> Column:
    """UTC ``timestamp_ntz`` of a time written year-first (``-`` or ``/``, blank or ``T``, optional ``Z`` or
    offset) or as whole seconds since 1970; null where it can't be read (also for the year 0000).

    Independent of the session's time zone: a time without offset is UTC.
    """
    s = F.regexp_replace(F.translate(raw, "/", "-"), r"^\s+|\s+$", "")
    shape = r"^(\d{4}-\d{1,2}-\d{1,2})(?:[Tt\s]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?\s*([Zz]|[+-]\d{1,2}:?\d{2})?$"
    day, clock, zone = (F.regexp_extract(s, shape, i) for i in (1, 2, 3))
    zone = F.when(zone.isin("", "Z", "z"), "+00:00").otherwise(F.regexp_replace(zone, r"^([+-]\d{1,2}):?(\d{2})$", "$1:$2"))
    clock = F.when(clock == "", "00:00:00").otherwise(clock)
    written = F.concat(day, F.lit(" "), clock, zone).try_cast("timestamp")
    seconds = F.timestamp_seconds(F.when(s.rlike(r"^\d{1,12}$"), s).try_cast("bigint"))
    readable = (day != "") & ~day.startswith("0000")
    ts = F.when(readable, written).otherwise(seconds)
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def micros(ntz: Column) -> Column:
    """Microseconds since 1970 of a ``timestamp_ntz``, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ntz.cast("timestamp_ntz"))


def split_kind(split: Column) -> Column:
    """``train``, ``valid`` or ``test`` of a split name in any case with blanks; null for anything else."""
    s = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    return F.when(s.isin("valid", "validation", "dev"), "valid").when(s.isin("train", "test"), s)
