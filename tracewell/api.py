"""The engine's service surface: one object per project, and a command line."""

from __future__ import annotations

import argparse
import json
import re
import time
import uuid
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import micros, report_tokens, terms
from .operators import code_graph, features
from .operators import graph as G
from .operators import snapshot as S
from .operators.model import fit_scorer, score
from .operators.ranking import collaborative, metrics, min_max, oversample
from .operators.similarity import earlier_similar
from .plans import prepare as plan
from .session import local_session, materialize
from .sources import files, sinks
from .streaming.hooks import title_commit

_TABLES, _CURRENT = ("nodes", "edges", "versions"), "current.txt"


def _files(spark: SparkSession, folder: str):
    """The file system of a folder and a maker of its paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _pointer(spark: SparkSession, folder: str) -> str | None:
    """Where the last saved graph of a folder lies."""
    fs, path = _files(spark, folder)
    if not fs.exists(path(f"{folder}/{_CURRENT}")):
        return None
    return f"{folder}/{spark.read.text(f'{folder}/{_CURRENT}').first()[0].strip()}"


_READ_ONLY = re.compile(r"^\s*(select|with|show|describe|explain|from|values|table)\b", re.I)


class Engine:
    """Versioned code graph of a project, as tables ``nodes``, ``edges`` and ``versions``.

    Every call returns a DataFrame; nothing is collected before the caller asks.
    """

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, versions: DataFrame):
        self.spark, self.nodes, self.edges, self.versions = spark, nodes, edges, versions

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Engine:
        """The graph that was saved last in ``folder``; also one whose three tables lie there directly."""
        at = _pointer(spark, folder)
        return cls(spark, *[spark.read.parquet(f"{at or folder}/{t}") for t in _TABLES])

    def save(self, folder: str) -> None:
        """Write the graph beside what is there, then point to it: a reader, this engine too, never meets a half-written or replaced table.

        The version before stays for those that still read it; older ones are deleted.
        """
        before = _pointer(self.spark, folder)
        at = f"{folder}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for name in _TABLES:
            getattr(self, name).write.parquet(f"{at}/{name}")
        fs, path = _files(self.spark, folder)
        out = fs.create(path(f"{folder}/{_CURRENT}"), True)
        out.writeBytes(at.rsplit("/", 1)[1])
        out.close()
        for status in fs.listStatus(path(folder)):
            name = status.getPath().getName()
            if status.isDirectory() and re.fullmatch(r"\d{20}-[0-9a-f]{8}", name) and name not in (at.rsplit("/", 1)[1], (before or "").rsplit("/", 1)[-1]):
                fs.delete(status.getPath(), True)
        self.nodes, self.edges, self.versions = (self.spark.read.parquet(f"{at}/{t}") for t in _TABLES)

    @classmethod
    def empty(cls, spark: SparkSession) -> Engine:
        nodes = "uri string, relative_uri string, version int, label string, commit_id string, not_declared boolean, deleted_ver int, chain_root string, chain_pos int, is_constructor boolean, source_code string, position string"
        return cls(spark, spark.createDataFrame([], nodes), spark.createDataFrame([], "src string, rel string, dst string"), spark.createDataFrame([], "version int, commit_id string"))

    def version(self, commit: str) -> int:
        v = G.version_of(self.versions, commit)
        if v < 0:
            raise ValueError(f"unknown commit {commit}")
        return v

    def snapshot(self, commit: str, detail: bool = False) -> dict[str, DataFrame]:
        """At a commit: ``nodes`` alive and declared, ``classes``, ``members`` of the classes, and the ``graph`` of their methods (calls, with
        ``detail`` parameters and return types too)."""
        v = self.version(commit)
        members = materialize(S.members_at(self.nodes, self.edges, v), "members")
        graph = S.sub_graph(self.nodes, self.edges, members.where("kind = 'Method'"), v, detail)
        return {
            "nodes": G.newest_at(self.nodes, v).where(G.declared()),
            "classes": members.where("kind = 'Class'").select("uri"),
            "members": members.where("kind <> 'Class'").select("class_uri", "kind", "uri"),
            "graph": graph,
            "calls": graph.where("rel = 'call'").select(F.col("uri").alias("src"), "rel", F.col("target").alias("dst")),
        }

    def diff(self, commit: str) -> DataFrame:
        """(change, kind, class_uri, old_uri, new_uri) against the commit before: classes and methods; members of new, renamed or deleted classes
        stand for themselves in those."""
        v = self.version(commit)
        if self.versions.where(F.col("version") < v).limit(1).count() == 0:
            raise ValueError("the first commit has no previous one")
        rows = S.diff_members(self.nodes, self.edges, v).where("not within and kind <> 'Variable'")
        return rows.select("change", "kind", F.coalesce("new_class", "old_class").alias("class_uri"), "old_uri", "new_uri")

    def update(self, changes: DataFrame, commit: str, links: DataFrame | None = None, properties: DataFrame | None = None) -> Engine:
        """The engine after a change set under a new commit; see ``snapshot.update_graph``."""
        v = (self.versions.agg(F.max("version")).first()[0] or 0) + 1
        nodes, edges = S.update_graph(self.nodes, self.edges, changes, v, commit, links, properties)
        versions = G.register_versions(self.versions, self.spark.createDataFrame([(v, commit)], "version int, commit_id string"))
        return Engine(self.spark, materialize(nodes, "nodes"), materialize(edges, "edges"), materialize(versions, "versions"))

    def ingest(self, folder: str, commit: str, skip_dirs: list[str] = (), skip_names: list[str] = ()) -> Engine:
        """The engine after reading the Java files of a commit below ``folder``: the first commit fills the graph, a later one adds what is new,
        modifies methods whose source differs, and deletes what is gone. New and modified methods get their relations."""
        found = code_graph.entities(files.java_files(self.spark, folder, skip_dirs, skip_names))
        v = self.versions.agg(F.max("version")).first()[0] or 0
        changed = materialize(code_graph.changes(self.nodes, found, v), "changes")
        links = code_graph.relations(found).join(changed.where("op <> 'DELETE'").select("relative_uri").distinct(), "relative_uri", "left_semi")
        return self.update(changed, commit, links, found.select("relative_uri", "is_constructor", "source_code", "position"))

    def add_similar(self, pairs: DataFrame) -> Engine:
        return Engine(self.spark, self.nodes, G.upsert_edges(self.edges, G.similar_edges(self.nodes, pairs)), self.versions)

    def triples(self, path: str | None = None) -> DataFrame:
        """Tab-separated triples of all edges between methods; also written to ``path``."""
        m = self.nodes.where("label in ('Method', 'API')").select("uri")
        e = self.edges.join(m.withColumnRenamed("uri", "src"), "src", "left_semi").join(m.withColumnRenamed("uri", "dst"), "dst", "left_semi")
        lines = e.select(F.concat_ws("\t", "src", "rel", "dst").alias("line"))
        if path:
            sinks.write_triples(lines, path)
        return lines

    def snapshot_triples(self, commit: str, path: str | None = None) -> DataFrame:
        """Tab-separated triples of one snapshot; also written to ``path``."""
        lines = S.snapshot_triples(self.nodes, self.edges, self.version(commit))
        if path:
            sinks.write_triples(lines, path)
        return lines

    def relations(self, uri: str, rels: list[str] | None = None) -> DataFrame:
        """(rel, dst, label): what a node points at, of the given relations only."""
        own = self.edges.where(F.col("src") == uri)
        own = own.where(F.col("rel").isin(rels)) if rels else own
        return own.join(self.nodes.select(F.col("uri").alias("dst"), "label"), "dst", "left").select("rel", "dst", "label")

    def metadata(self) -> DataFrame:
        return G.metadata(self.nodes, self.edges, self.versions)

    def sql(self, query: str) -> DataFrame:
        """A read-only query over the views ``nodes``, ``edges`` and ``versions``."""
        if not _READ_ONLY.match(query) or re.search(r"\b(insert|overwrite|create|drop|alter|merge|delete|update|truncate)\s+(into|table|view|from|overwrite|or)\b", query, re.I):
            raise ValueError("only queries are allowed")
        return self.spark.sql(query, nodes=self.nodes, edges=self.edges, versions=self.versions) if "{" in query else self._viewed(query)

    def _viewed(self, query: str) -> DataFrame:
        for name in ("nodes", "edges", "versions"):
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    def localize(
        self,
        title: str,
        body: str,
        at: datetime,
        reports: DataFrame,
        fixed: DataFrame,
        model: PipelineModel | None = None,
        k: int = 50,
        top: int | None = None,
        commit: str | None = None,
        method_of: DataFrame | None = None,
    ) -> DataFrame:
        """(method_id, score, bff, bfr, cfs), best first: methods for a new report from the earlier ones.

        ``reports``: stored (bug_id, at, terms) with a ``timestamp_ntz``; ``fixed``: stored (bug_id, method_id). ``cfs`` is the collaborative score
        from the ``k`` reports most like it, ``bff`` and ``bfr`` the number and recency of earlier fixes. ``score`` is the model's
        probability (fitted on those three), without a model ``cfs``. Candidates are the methods with a collaborative score. With
        ``commit`` only methods alive at it count (the title's ``commitId`` if it names one): ``method_of`` (method_id, relative_uri) ties them to the graph.
        """
        spark = self.spark
        new = spark.createDataFrame([(-1, at, title, body)], "bug_id bigint, at timestamp_ntz, title string, body string")
        asked = materialize(new.select("bug_id", "at", terms(report_tokens(F.col("title"), F.col("body"))).alias("terms"), title_commit(F.col("title")).alias("commit")), "asked")
        texts = lambda df: df.select(F.col("bug_id").alias("id"), micros(F.col("at")).alias("at"), "terms")
        seeds = materialize(earlier_similar(texts(asked), texts(reports), k), "seeds")
        times = reports.select(F.col("bug_id").alias("node"), "at").unionByName(asked.select(F.col("bug_id").alias("node"), "at"))
        links = materialize(features.report_links(fixed, seeds), "links")
        similar = G.undirected(features.method_links(fixed).withColumnRenamed("sim_score", "sim"), "method1", "method2", "sim")
        cfs = collaborative(seeds, links, fixed.select(F.col("bug_id").alias("node"), "method_id"), materialize(similar, "similar"), k, times)
        rows = cfs.select(F.col("query").alias("bug_id"), "method_id", "cfs").join(asked.select("bug_id", "at"), "bug_id").withColumn("train", F.lit(False))
        wanted = asked.first()["commit"] or commit
        if wanted and method_of is not None:
            alive = G.newest_at(self.nodes, self.version(wanted)).select("relative_uri")
            rows = rows.join(method_of.join(alive, "relative_uri", "left_semi").select("method_id").distinct(), "method_id", "left_semi")
        fixes = fixed.join(reports.select("bug_id", "at"), "bug_id").withColumn("train", F.lit(True))
        full = features.candidate_history(rows, fixes)
        scored = score(model, full).withColumnRenamed("buggy_rate", "score") if model else full.withColumn("score", F.col("cfs"))
        best = scored.select("method_id", "score", "bff", "bfr", "cfs").orderBy(F.col("score").desc(), "method_id")
        return best.limit(top) if top else best


def prepare(spark: SparkSession, data: str, out: str) -> None:
    """Write the features of all reports' candidates of the tables in ``data``: (bug_id, method_id, label, train, bff, bfr, cfs, ...)."""
    plan.prepare(spark, data, asked="true").write.mode("overwrite").parquet(f"{out}/features")


def train(spark: SparkSession, out: str, hidden: int = 0, copies: int = 300) -> None:
    """Fit the learner on the scaled, over-sampled training features and save it."""
    rows = min_max(spark.read.parquet(f"{out}/features").where("train").withColumn("label", F.col("label").cast("double")), plan.SCORES)
    fit_scorer(oversample(rows, F.col("label") == 1, copies), plan.SCORES, hidden).write().overwrite().save(f"{out}/model")


def test(spark: SparkSession, out: str) -> None:
    """Score all test candidates with the saved learner; test and training rows are scaled separately."""
    rows = min_max(spark.read.parquet(f"{out}/features").where("not train"), plan.SCORES)
    score(PipelineModel.load(f"{out}/model"), rows).write.mode("overwrite").parquet(f"{out}/scores")


def evaluate(spark: SparkSession, out: str) -> DataFrame:
    """hit@k, MAP and MRR of the scored test reports."""
    return metrics(spark.read.parquet(f"{out}/scores"), "bug_id", "buggy_rate", "label", "method_id")


def main(args: list[str] | None = None) -> None:
    """``python -m tracewell.api FOLDER COMMAND [ARG]`` prints JSON lines.

    On a saved graph: snapshot COMMIT, diff COMMIT, triples COMMIT, metadata, sql QUERY, ingest SOURCE --commit ID (makes the graph if there is none).
    On a folder of features: prepare DATA, train, test, evaluate, in this order; run DATA does all four.
    """
    stages = ["prepare", "train", "test", "evaluate", "run"]
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("folder")
    p.add_argument("command", choices=["snapshot", "diff", "triples", "metadata", "sql", "ingest", *stages])
    p.add_argument("argument", nargs="?", default="")
    p.add_argument("--commit", default="")
    p.add_argument("--skip", action="append", default=[], help="part of a path that isn't read; * stands for anything")
    a = p.parse_args(args)
    spark = SparkSession.getActiveSession() or local_session()
    if a.command in stages:
        if a.command in ("prepare", "run"):
            prepare(spark, a.argument, a.folder)
        if a.command in ("train", "run"):
            train(spark, a.folder)
        if a.command in ("test", "run"):
            test(spark, a.folder)
        df = evaluate(spark, a.folder) if a.command in ("evaluate", "run") else None
    elif a.command == "ingest":
        fs, path = _files(spark, a.folder)
        engine = Engine.load(spark, a.folder) if fs.exists(path(a.folder)) else Engine.empty(spark)
        engine = engine.ingest(a.argument, a.commit, a.skip)
        engine.save(a.folder)
        df = engine.metadata()
    else:
        engine = Engine.load(spark, a.folder)
        df = {
            "snapshot": lambda: engine.snapshot(a.argument)["members"],
            "diff": lambda: engine.diff(a.argument),
            "triples": lambda: engine.snapshot_triples(a.argument),
            "metadata": engine.metadata,
            "sql": lambda: engine.sql(a.argument),
        }[a.command]()
    for row in df.toLocalIterator() if df is not None else ():
        print(json.dumps(row.asDict(recursive=True), default=str))


if __name__ == "__main__":
    main()
