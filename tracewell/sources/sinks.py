"""Writers: staging CSV, triples, JSON documents, appended text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_PROPERTIES = ["label", "commitID", "notDeclared", "isConstructor", "deletedVer", "sourceCode", "position"]


def pivot_triples(triples: DataFrame, literal: str = "is_literal") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of RDF-like triples (s, p, o, is_literal, seq): literals become properties, the last writer wins, the rest edges.

    An absent property is null: "don't overwrite" for whoever merges the result.
    """
    n = triples.where(F.col(literal) | (F.col("p") == "label")).groupBy(F.col("s").alias("uri"))
    nodes = n.agg(*[F.max(F.when(F.col("p") == p, F.struct("seq", "o")))["o"].alias(p) for p in NODE_PROPERTIES])
    edges = triples.where(~F.col(literal) & (F.col("p") != "label")).select(F.col("s").alias("node1"), F.col("p").alias("relation"), F.col("o").alias("node2")).distinct()
    return nodes, edges


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_triples(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def snapshot_json(members: DataFrame) -> DataFrame:
    """(doc): one JSON document per class of (class_uri, uri, code)."""
    node = F.struct(F.create_map(F.lit("uri"), F.col("uri"), F.lit("sourceCode"), F.col("code")).alias("propertys"))
    one = members.groupBy("class_uri").agg(F.array_sort(F.collect_list(node.getField("propertys")["uri"])).alias("uris"), F.collect_list(node).alias("nodes"))
    return one.select("class_uri", F.to_json(F.struct(F.create_map("class_uri", "nodes").alias("methodMap"))).alias("doc"))
