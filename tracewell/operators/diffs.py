"""Unified diffs: their lines, and what they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_lines(diffs: DataFrame) -> DataFrame:
    """(id, file, old_file, new_file, pos, kind, old_line, new_line, content) of unified diffs (id, body) of any number of files.

    A file starts at ``diff --git``, or where there is none at ``---`` before ``+++`` and ``@@``; a hunk header sets the line numbers. Only lines
    of hunks come out: no headers, no ``\\ No newline at end of file``. ``kind`` is ``-``, ``+`` or a blank; line numbers stand
    on the side that holds the line, null on the other. ``old_file`` and ``new_file`` are paths without their ``a/`` and ``b/``, null for ``/dev/null``.
    A body without any header is one whole file whose lines count from 1, both files null. A null body has no lines.
    """
    lines = diffs.select("id", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line"))
    own = Window.partitionBy("id").orderBy("pos")
    far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    git = F.startswith("line", F.lit("diff --git "))
    hunk = F.regexp_extract_all("line", F.lit(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"), F.lit(1))
    marked = lines.select(
        "id",
        "pos",
        "line",
        git.alias("git"),
        (F.size(hunk) > 0).alias("hunk"),
        (F.startswith("line", F.lit("--- ")) & F.startswith(F.lead("line").over(own), F.lit("+++ ")) & F.startswith(F.lead("line", 2).over(own), F.lit("@@ "))).alias("plain"),
    )
    # a plain header counts as a start where no git header is open, that is where the last mark before it is a hunk or nothing
    mark = F.when(F.col("git"), "git").when(F.col("hunk"), "hunk")
    opened = marked.withColumn("last", F.last(mark, True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    starts = opened.withColumn("start", F.col("git") | F.coalesce(F.col("plain") & ~F.coalesce(F.col("last") == "git", F.lit(False)), F.lit(False)))
    numbered = starts.select("*", F.sum(F.col("start").cast("int")).over(far).alias("file"), F.max("hunk").over(Window.partitionBy("id")).alias("_headed"))
    in_file = Window.partitionBy("id", "file").orderBy("pos")
    so_far = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = lambda mark: F.regexp_extract("line", rf"^{mark} (?:[ab]/)?([^\t]*?)(?:\t.*)?$", 1)
    hunks = numbered.withColumn("_hunk", F.sum(F.col("hunk").cast("int")).over(so_far))
    head = F.col("_hunk") == 0
    named = lambda mark: F.first(F.when(head & F.startswith("line", F.lit(mark + " ")), path(mark.replace("+", r"\+"))), True).over(Window.partitionBy("id", "file"))
    files = hunks.select("*", *[F.nullif(F.nullif(named(m), F.lit("/dev/null")), F.lit("")).alias(n) for m, n in (("---", "old_file"), ("+++", "new_file"))])
    content = F.col("_headed") & (F.col("_hunk") > 0) & ~F.col("hunk") & ~F.startswith("line", F.lit("\\")) | ~F.col("_headed")
    kind = F.when(F.left("line", F.lit(1)).isin("+", "-"), F.left("line", F.lit(1))).otherwise(" ")
    # an empty last line is the end of the text, not a line of it
    ended = (F.col("line") == "") & F.lead("line").over(own).isNull() & F.col("_headed")
    body = files.select("*", kind.alias("kind"), (content & ~ended).alias("_in"))
    in_hunk = Window.partitionBy("id", "file", "_hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lambda i: F.coalesce(F.max(F.regexp_extract("line", r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", i).try_cast("int")).over(Window.partitionBy("id", "file", "_hunk")), F.lit(1))
    counted = body.select(
        "*",
        (first(1) - 1 + F.sum(F.when(F.col("_in") & (F.col("kind") != "+"), 1).otherwise(0)).over(in_hunk)).alias("_old"),
        (first(2) - 1 + F.sum(F.when(F.col("_in") & (F.col("kind") != "-"), 1).otherwise(0)).over(in_hunk)).alias("_new"),
    )
    return counted.where("_in").select(
        "id",
        "file",
        "old_file",
        "new_file",
        "pos",
        "kind",
        F.when(F.col("kind") != "+", F.col("_old")).alias("old_line"),
        F.when(F.col("kind") != "-", F.col("_new")).alias("new_line"),
        F.expr("substring(line, 2)").alias("content"),
    )


def file_changes(lines: DataFrame) -> DataFrame:
    """(id, file, old_file, new_file, op, renamed): each file of ``file_lines`` as added, deleted or modified, and whether its name changed."""
    files = lines.select("id", "file", "old_file", "new_file").distinct()
    op = F.when(F.col("old_file").isNull() & F.col("new_file").isNotNull(), "ADD").when(F.col("new_file").isNull() & F.col("old_file").isNotNull(), "DELETE").otherwise("MODIFY")
    return files.select("*", op.alias("op"), F.coalesce((op == "MODIFY") & (F.col("old_file") != F.col("new_file")), F.lit(False)).alias("renamed"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(id, pos, kind, old_line, new_line, content) of diffs (id, body) of one file each; see ``file_lines``."""
    return file_lines(diffs).select("id", "pos", "kind", "old_line", "new_line", "content")


def method_states(lines: DataFrame, old_methods: DataFrame, new_methods: DataFrame) -> DataFrame:
    """(id, method, state, op) of methods (id, method, first, signature_end, last) on both sides of a diff.

    A method is deleted if all its lines are (4, DELETE) and added if all are (5, ADD); else changed lines in its signature
    (1), its body (2) or both (3) modify it. Untouched methods are left out. Lines join methods by file and interval.
    """

    def touched(side: str, kind: str, methods: DataFrame) -> DataFrame:
        m = methods.select("id", "method", "first", "signature_end", "last")
        hit = lines.where(F.col("kind") == kind).select("id", F.col(side).alias("n")).join(m, "id").where(F.col("n").between(F.col("first"), F.col("last")))
        return hit.groupBy("id", "method").agg(
            F.max((F.col("n") <= F.col("signature_end")).cast("int")).alias("sig"), F.max((F.col("n") > F.col("signature_end")).cast("int")).alias("body"), (F.count("*") == F.max(F.col("last") - F.col("first") + 1)).alias("whole")
        )

    old = touched("old_line", "-", old_methods).withColumnsRenamed({"sig": "so", "body": "bo", "whole": "wo"})
    new = touched("new_line", "+", new_methods).withColumnsRenamed({"sig": "sn", "body": "bn", "whole": "wn"})
    both = old.join(new, ["id", "method"], "full").fillna({"so": 0, "bo": 0, "sn": 0, "bn": 0, "wo": False, "wn": False})
    part = F.greatest("so", "sn") + 2 * F.greatest("bo", "bn")
    state = F.when(F.col("wo") & ~F.col("wn"), 4).when(F.col("wn") & ~F.col("wo"), 5).otherwise(part)
    return both.select("id", "method", state.alias("state"), F.when(state == 4, "DELETE").when(state == 5, "ADD").otherwise("MODIFY").alias("op"))


def item_changes(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., op) of classes or fields between two sides (key, value): ADD, DELETE, or MODIFY where the value differs."""
    both = old.select(*key, F.col(value).alias("_o"), F.lit(True).alias("_io")).join(new.select(*key, F.col(value).alias("_n"), F.lit(True).alias("_in")), key, "full")
    op = F.when(F.col("_io").isNull(), "ADD").when(F.col("_in").isNull(), "DELETE").when(~F.col("_o").eqNullSafe(F.col("_n")), "MODIFY")
    return both.select(*key, op.alias("op")).where("op is not null")
