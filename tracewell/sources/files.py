"""Readers of the text formats that the engine takes in. Explicit schemas, no inference, no row limits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefix import range_sums

REPORT_CSV = "bug_id string, commit_id string, summary string, description string, commit_time string, method string"
NODE_CSV = "uri string, label string, commitID string, notDeclared string, isConstructor string, deletedVer string, sourceCode string, position string"
EDGE_CSV = "node1 string, relation string, node2 string"
SNAPSHOT_JSON = "methodMap map<string, array<struct<propertys: map<string, string>>>>"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def reports_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, REPORT_CSV)


def nodes_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, NODE_CSV)


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, EDGE_CSV)


def _order() -> list[Column]:
    """What orders the rows of text files by file name and place: within one split of a file the running number does."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n")]


_ORDER = ["_file", "_block", "_n"]


def _ordered(rows: DataFrame) -> DataFrame:
    """(commit_id, ord) of rows (commit_id, ``_ORDER``...): each commit once, numbered from 0 in order of first appearance."""
    first = rows.where("commit_id is not null and commit_id <> ''").groupBy("commit_id").agg(F.min(F.struct(*_ORDER, *(["k"] if "k" in rows.columns else []))).alias("o"))
    return range_sums(first.withColumn("_one", F.lit(1)), [], [F.col("o").asc()], {"ord": "_one"}).select("commit_id", "ord")


def commits_csv(spark: SparkSession, path: str) -> DataFrame:
    """(commit_id, ord): commits of a list of (pre_commit_id, commit_id) rows, each once, in order of appearance."""
    rows = spark.read.csv(path, header=True).select("pre_commit_id", "commit_id", *_order())
    return _ordered(rows.select(*_ORDER, F.posexplode(F.array("pre_commit_id", "commit_id")).alias("k", "commit_id")))


def commit_db(spark: SparkSession, path: str) -> DataFrame:
    """(commit_id, ord) of lines (number, commit before the fix, commit after it, ...) that stand newest first: the commits after, each once, oldest first."""
    first = _ordered(spark.read.text(path).select(*_order(), F.try_element_at(F.split("value", ","), F.lit(3)).alias("commit_id")))
    return first.withColumn("ord", F.lit(first.count() - 1) - F.col("ord"))


def commit_column(spark: SparkSession, path: str, column: int = 6) -> DataFrame:
    """(commit_id, ord) of one column (from 0) of a CSV file without header, that stands newest first; commits with the same first seven characters are one."""
    names = ", ".join(f"c{i} string" for i in range(column + 1))
    rows = spark.read.schema(names).csv(path).select(F.trim(f"c{column}").alias("commit_id"), *_order())
    whole = rows.groupBy(F.left("commit_id", F.lit(7)).alias("_short")).agg(F.max(F.struct(*_ORDER, "commit_id")).alias("o")).select("o.commit_id", *[f"o.{c}" for c in _ORDER])
    first = _ordered(whole)
    return first.withColumn("ord", F.lit(first.count() - 1) - F.col("ord"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(ord, commit_id, time) of the text that ``git log`` prints, newest first: ``ord`` counts from the oldest commit, 0. ``time`` is UTC."""
    lines = spark.read.text(path).select("value", *_order())
    w = Window.orderBy(*_ORDER)
    commit, date = F.regexp_extract("value", r"^commit ([0-9a-f]{7,64})\b", 1), F.regexp_extract("value", r"^Date:\s+(.*\S)\s*$", 1)
    marked = lines.select(*_ORDER, F.nullif(commit, F.lit("")).alias("commit_id"), F.nullif(date, F.lit("")).alias("date")).where("commit_id is not null or date is not null")
    # a log is one text that one program prints; only its commit and date lines are ordered
    own = marked.withColumn("date", F.lead("date").over(w)).where("commit_id is not null")
    first = _ordered(own)
    written = F.regexp_replace("date", r"^\w{3} ", "")
    at = F.coalesce(F.try_to_timestamp(written, F.lit("MMM d HH:mm:ss yyyy Z")), F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp("date"))
    return own.join(first, "commit_id").groupBy("commit_id").agg(F.min("ord").alias("_o"), F.max(at).alias("time")).select((F.lit(first.count() - 1) - F.col("_o")).alias("ord"), "commit_id", "time")


def edge_list(spark: SparkSession, path: str, score: int | None = None) -> DataFrame:
    """(id1, id2[, score]) of a file of columns between blanks, without header; unreadable lines are left out."""
    c = F.split(F.trim("value"), r"\s+")
    cols = [F.try_element_at(c, F.lit(i)).try_cast("bigint").alias(f"id{i}") for i in (1, 2)]
    extra = [] if score is None else [F.try_element_at(c, F.lit(score + 1)).try_cast("double").alias("score")]
    return spark.read.text(path).select(*cols, *extra).dropna(subset=["id1", "id2"])


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, uri), split at the first blank; of lines with the same id the first counts."""
    c = F.split("value", r"\s+", 2)
    rows = spark.read.text(path).select(c[0].try_cast("bigint").alias("id"), F.try_element_at(c, F.lit(2)).alias("uri"), *_order())
    return rows.dropna(subset=["id", "uri"]).groupBy("id").agg(F.min_by("uri", F.struct(*_ORDER)).alias("uri"))


def snapshot_methods(spark: SparkSession, path: str) -> DataFrame:
    """(method_uri, code) of snapshot documents; of a URI's copies the last counts."""
    doc = spark.read.schema(SNAPSHOT_JSON).json(path, multiLine=True).select(F.struct(*_order()).alias("n"), F.explode("methodMap").alias("class", "methods"))
    flat = doc.select("n", "class", F.posexplode("methods").alias("pos", "m")).select(F.col("m.propertys")["uri"].alias("method_uri"), F.col("m.propertys")["sourceCode"].alias("code"), F.struct("n", "class", "pos").alias("o"))
    return flat.where("method_uri is not null").groupBy("method_uri").agg(F.max_by("code", "o").alias("code"))


def java_files(spark: SparkSession, path: str, skip_dirs: list[str] = (), skip_names: list[str] = ()) -> DataFrame:
    """(path, code) of the Java files below a folder; ``skip_dirs`` are parts of their paths from its own name on (``*`` stands for anything), ``skip_names`` parts of file names."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))
    above = re.sub("^[a-z0-9]+:/*", "", path).strip("/").rpartition("/")[0]
    below = F.regexp_replace("path", f"^.*?{_quoted(above)}/", "/") if above else F.col("path")
    for pattern in skip_dirs:
        files = files.where(~below.rlike(".*".join(map(_quoted, pattern.split("*")))))
    for name in skip_names:
        files = files.where(~F.element_at(F.split("path", "/"), -1).contains(name))
    return files


def _quoted(text: str) -> str:
    return re.escape(text)


def first_json_row(spark: SparkSession, path: str, schema: str, **equal: str) -> DataFrame:
    """The first row of a JSON-lines file whose fields equal the given values."""
    df = spark.read.schema(schema).json(path)
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    return df.limit(1)
