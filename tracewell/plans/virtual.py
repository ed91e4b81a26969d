"""Versioned-graph and report tables derived from the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features
from ..session import materialize, table


def reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("bug_id"), F.col("o_orderdate").alias("commit_time"))


def report_methods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bug_id"), F.col("l_partkey").alias("method_id")).distinct()


def methods(spark: SparkSession, d: str) -> DataFrame:
    uri = F.concat("p_brand", F.lit("."), "p_type", F.lit("-"), "p_name", F.lit("("), F.col("p_partkey").cast("string"), F.lit(")"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("method_id"), uri.alias("method_uri"))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("dst is not null and src <> dst").distinct()


def method_links(spark: SparkSession, d: str) -> DataFrame:
    return features.method_links(materialize(report_methods(spark, d), "fixes"))


def report_links(spark: SparkSession, d: str, of: DataFrame, block: int = 1000) -> DataFrame:
    return features.report_links(materialize(report_methods(spark, d), "fixes"), of, block)


def versions(spark: SparkSession, d: str) -> DataFrame:
    """(version, day, commit_id): one version per day with events; the window holds one row per day."""
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    ranked = days.withColumn("version", F.row_number().over(Window.orderBy("day")))
    return ranked.select("version", "day", F.md5(F.date_format("day", "yyyy-MM-dd")).alias("commit_id"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Method nodes: the last event of a user and version; a chain's last node can be a tombstone."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", F.to_date("ts").alias("day"))
    v = e.join(F.broadcast(versions(spark, d)), "day")  # days are bounded by time, not by events
    last = v.groupBy("user_id", "version", "commit_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("e"))
    chain = Window.partitionBy("user_id").orderBy("version")
    n = last.select("*", F.lead("version").over(chain).alias("next_version"), F.first("version").over(chain).alias("first_version"), F.row_number().over(chain).alias("chain_pos"))
    rel = F.concat(F.lit("C"), F.col("user_id") % 10, F.lit("-u"), F.col("user_id"), F.lit("(int,List)"))
    return n.select(
        F.concat(rel, F.lit("#"), F.col("version")).alias("uri"),
        rel.alias("relative_uri"),
        "version",
        F.when(F.col("user_id") % 7 == 0, "API").otherwise("Method").alias("label"),
        "commit_id",
        (F.col("user_id") % 11 == 0).alias("not_declared"),
        F.when(F.col("next_version").isNull() & (F.col("e.event_type") == "error"), F.col("version")).alias("deleted_ver"),
        F.concat(rel, F.lit("#"), F.col("first_version")).alias("chain_root"),
        "chain_pos",
        F.concat(rel, F.lit("#"), F.col("next_version")).alias("next_uri"),
        F.concat(F.lit("C"), F.col("user_id") % 10).alias("class_uri"),
        "user_id",
    )


def update_edges(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where("next_uri is not null").select(F.col("uri").alias("src"), F.lit("update").alias("rel"), F.col("next_uri").alias("dst"))


#: Versions at which classes of the class graph change: born, renamed, deleted.
BORN, RENAMED, DELETED = 4, 6, 8


def class_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with classes over the method nodes: members, fields, parameters with types, return types, calls.

    Classes are the users' last digits. Class 8 is born at BORN, classes 1, 4 and 7 are renamed at RENAMED, class 9 is deleted at DELETED.
    """
    n = materialize(nodes(spark, d), "nodes").withColumn("k", (F.col("user_id") % 10).cast("int"))
    none = F.lit(None).cast("int")
    k = n.select("k").distinct()
    first_version = F.when(F.col("k") == 8, BORN).otherwise(1)
    old = F.concat(F.lit("C"), "k", F.lit("#"), first_version)
    renamed = F.concat(F.lit("D"), "k", F.lit(f"#{RENAMED}"))
    columns = ["uri", "relative_uri", "version", "label", "not_declared", "deleted_ver", "chain_root"]

    def made(df: DataFrame, uri, version, label: str, deleted=none, root=None) -> DataFrame:
        return df.select(uri.alias("uri"), F.substring_index(uri, "#", 1).alias("relative_uri"), version.cast("int").alias("version"), F.lit(label).alias("label"), F.lit(False).alias("not_declared"), deleted.alias("deleted_ver"), (uri if root is None else root).alias("chain_root"))

    field = F.concat(F.lit("C"), "k", F.lit("-f#"), first_version)
    param = F.concat("relative_uri", F.lit("-parameter-0#"), "version")
    all_nodes = n.select(*columns)
    for more in (
        made(k, old, first_version, "Class", F.when(F.col("k") == 9, DELETED)),
        made(k.where("k % 3 = 1"), renamed, F.lit(RENAMED), "Class", root=old),
        made(k, field, first_version, "Variable"),
        made(n, param, F.col("version"), "Parameter"),
    ):
        all_nodes = all_nodes.unionByName(more)
    first = n.where("chain_pos = 1").select("k", "version", F.col("uri").alias("dst"))
    member = first.unionByName(k.select("k", first_version.alias("version"), field.alias("dst")))
    late = (F.col("k") % 3 == 1) & (F.col("version") >= RENAMED)
    edge = lambda df, src, rel, dst: df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    other = lambda i: F.concat(F.lit("C"), (F.col("k") + i) % 10, F.lit("#"), F.when((F.col("k") + i) % 10 == 8, BORN).otherwise(1))
    called = n.where("chain_pos = 1").select((F.col("user_id") - 1).alias("user_id"), F.col("uri").alias("dst"))
    all_edges = edge(member.where(~late), old, "has", F.col("dst"))
    for more in (
        edge(member.where("k % 3 = 1"), renamed, "has", F.col("dst")),
        edge(n, F.col("uri"), "has", param),
        edge(n, param, "instanceof", other(1)),
        edge(n, F.col("uri"), "returnType", other(3)),
        edge(n.select("uri", "user_id").join(called, "user_id"), F.col("uri"), "call", F.col("dst")),
    ):
        all_edges = all_edges.unionByName(more)
    return materialize(all_nodes, "class_nodes"), materialize(all_edges, "class_edges")


# The same in SQL, for comparison.
SQL = r"""
 ver AS (SELECT day, CAST(dense_rank() OVER (ORDER BY day) AS INTEGER) AS version, md5(strftime(day, '%Y-%m-%d')) AS commit_id FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) q),
 lastv AS (SELECT * FROM (SELECT e.*, version, commit_id, row_number() OVER (PARTITION BY user_id, version ORDER BY ts DESC, event_id DESC) AS rn FROM events e JOIN ver ON CAST(ts AS DATE) = day) q WHERE rn = 1),
 nx AS (SELECT *, lead(version) OVER (PARTITION BY user_id ORDER BY version) AS next_version, first_value(version) OVER (PARTITION BY user_id ORDER BY version) AS first_version,
   CAST(row_number() OVER (PARTITION BY user_id ORDER BY version) AS INTEGER) AS chain_pos, concat('C', user_id % 10, '-u', user_id, '(int,List)') AS relative_uri FROM lastv),
 nodes AS (SELECT concat(relative_uri, '#', version) AS uri, relative_uri, version, CASE WHEN user_id % 7 = 0 THEN 'API' ELSE 'Method' END AS label, commit_id, user_id % 11 = 0 AS not_declared,
   CASE WHEN next_version IS NULL AND event_type = 'error' THEN version END AS deleted_ver, concat(relative_uri, '#', first_version) AS chain_root, chain_pos,
   CASE WHEN next_version IS NOT NULL THEN concat(relative_uri, '#', next_version) END AS next_uri, concat('C', user_id % 10) AS class_uri, user_id FROM nx)"""


def members_sql(v: int, name: str) -> str:
    """CTEs ``live<name>`` (k, class_uri), ``now<name>`` (methods alive) and ``members<name>`` at a version, after SQL."""
    return f"""
 live{name} AS (SELECT k, CASE WHEN k % 3 = 1 AND {v} >= {RENAMED} THEN concat('D', k, '#{RENAMED}') WHEN k = 8 THEN 'C8#{BORN}' ELSE concat('C', k, '#1') END AS class_uri
  FROM (SELECT DISTINCT user_id % 10 AS k FROM nodes) q WHERE NOT (k = 9 AND {v} >= {DELETED}) AND NOT (k = 8 AND {v} < {BORN})),
 now{name} AS (SELECT n.* FROM (SELECT chain_root, max(version) FILTER (WHERE version <= {v}) AS v, min(deleted_ver) AS gone FROM nodes GROUP BY chain_root) g JOIN nodes n ON n.chain_root = g.chain_root AND n.version = g.v WHERE gone IS NULL OR gone > {v}),
 members{name} AS (SELECT k, class_uri, 'Class' AS kind, concat('class', k) AS root, class_uri AS uri FROM live{name}
  UNION ALL SELECT k, class_uri, 'Variable', concat('field', k), concat('C', k, '-f#', CASE WHEN k = 8 THEN {BORN} ELSE 1 END) FROM live{name}
  UNION ALL SELECT k, l.class_uri, 'Method', n.chain_root, n.uri FROM now{name} n JOIN live{name} l ON l.k = n.user_id % 10 WHERE n.label = 'Method')"""
