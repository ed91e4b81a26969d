"""Queries of the text, diff, code and model operators, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalise import PUNCTUATION, normal_words, stems
from ..functions.text import clean_time, micros, terms
from ..operators import diffs as D
from ..operators import java as J
from ..operators import model as M
from ..operators import ranking as R
from ..operators.current import current_rows
from ..operators.shred import issue_events
from ..operators.similarity import earlier_similar, nearest, pair_cosine
from ..session import materialize, table
from ..sources.sinks import pivot_triples
from ..streaming.hooks import is_bug, result_rows, title_commit
from .training import EVENTS_SQL

STOP = ["the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "that", "don't"]


def normalised_reports(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "bug_reports")
    return r.select("row_id", F.array_join(normal_words(F.concat_ws(" ", "summary", "description"), STOP), " ").alias("words"))


def stemmed_reports(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "bug_reports")
    return r.select("row_id", stems(normal_words(F.concat_ws(" ", "summary", "description"))).alias("stems"))


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bug_reports").select(F.col("row_id").alias("id"), terms(F.col("report")).alias("terms"))


def report_pair_cosine(s: SparkSession, d: str) -> DataFrame:
    """Each report row with the one 7 rows on."""
    pairs = table(s, d, "bug_reports").select(F.col("row_id").alias("a"), (F.col("row_id") + 7).alias("b"))
    return pair_cosine(pairs, _texts(s, d)).select("a", "b", F.round("score", 6).alias("score"))


def earlier_reports(s: SparkSession, d: str) -> DataFrame:
    """The 50 earlier reports most like each current report whose bug_id is divisible by 50."""
    r = current_rows(table(s, d, "bug_reports"), ["bug_id"], ["loaded_at", "row_id"], ["loaded_at", "row_id", "commit_time", "report"])
    t = materialize(r.select(F.col("bug_id").alias("id"), micros(clean_time(F.col("commit_time"))).alias("at"), terms(F.col("report")).alias("terms")).where("at is not null"), "reports")
    out = earlier_similar(t.where("id % 50 = 0"), t)
    return out.select("query", "node", F.round("score", 6).alias("score"))


def issue_filters(s: SparkSession, d: str) -> DataFrame:
    """Every event of the issue payloads with its bug label test and the commit that its title names."""
    e = issue_events(table(s, d, "view_issue"), "hook_id", "payload")
    return e.select(F.col("key").alias("hook_id"), "event_pos", is_bug(F.col("labels")).alias("bug"), title_commit(F.col("title")).alias("commit"))


def ranked_results(s: SparkSession, d: str) -> DataFrame:
    """Result strings of each bug's methods, parsed back."""
    f = table(s, d, "features").where("method_name is not null and buggy_rate >= 0 and not isnan(buggy_rate)").groupBy("bug_id", "method_name").agg(F.max("buggy_rate").alias("p"))
    text = f.groupBy("bug_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("('"), "method_name", F.lit("', "), F.format_string("%.4f", "p"), F.lit(")")))), ", "), F.lit("]")).alias("r"))
    return result_rows(text, "r").select("bug_id", "place", "uri", F.round("probability", 4).alias("probability"))


def diff_lines(s: SparkSession, d: str) -> DataFrame:
    """Documents read as whole-file diffs: a line's first character tells its kind, made from its place."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("+"), F.lit(" ")), F.pmod(i * 7 + F.length(x), F.lit(4)) + 1), x)), "\n")
    t = table(s, d, "documents").where("kind = 'code' and text is not null").select(F.col("doc_id").alias("id"), body.alias("body"))
    lines = D.diff_lines(t)
    return lines.select("id", "pos", "kind", F.coalesce("old_line", F.lit(0)).alias("old_line"), F.coalesce("new_line", F.lit(0)).alias("new_line"))


def version_changes(s: SparkSession, d: str) -> DataFrame:
    """Methods added, deleted or changed between the versions up to 20 and up to 30, by their newest row; one whose newest row is a DELETE is gone."""
    v = table(s, d, "method_versions").withColumn("gone", F.coalesce(F.col("op") == "DELETE", F.lit(False)))
    last = lambda n: v.where(f"version <= {n}").groupBy("method_id").agg(F.max(F.struct("version", "gone", F.coalesce("source_code", F.lit("")).alias("code"))).alias("_n"))
    newest = lambda n: last(n).where("not _n.gone").select("method_id", "_n.code")
    return D.item_changes(newest(20), newest(30), ["method_id"], "code")


def code_outlines(s: SparkSession, d: str) -> DataFrame:
    return J.outlines(table(s, d, "documents").where("kind = 'code'").select(F.col("doc_id").alias("id"), F.col("text").alias("code")))


def staged_nodes(s: SparkSession, d: str) -> DataFrame:
    """Triples of method versions pivoted to wide nodes."""
    v = table(s, d, "method_versions").select("uri", "version", "known_at", F.posexplode(F.array("label", "commit_id", "not_declared")).alias("k", "o")).where("o is not null")
    p = F.element_at(F.array(F.lit("label"), F.lit("commitID"), F.lit("notDeclared")), F.col("k") + 1)
    nodes, _ = pivot_triples(v.select(F.col("uri").alias("s"), p.alias("p"), "o", F.lit(True).alias("is_literal"), F.col("o").alias("seq")))
    return nodes.select("uri", "label", "commitID", "notDeclared")


def nearest_embeddings(s: SparkSession, d: str) -> DataFrame:
    """The ten other vectors most like each vector whose id is divisible by 50."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(e.where("id % 50 = 0"), e, 10).select("query", "node", F.round("score", 6).alias("score"))


def neighbour_cosines(s: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with the one after it."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(M.cosine(F.col("a"), F.col("b")), 5).alias("cosine"))


def learned_metrics(s: SparkSession, d: str) -> DataFrame:
    """hit@k, MAP and MRR of bugs with an even id, ranked by a regression fitted on the others."""
    clean = lambda c: F.when((F.col(c) >= 0) & ~F.isnan(c), F.col(c)).otherwise(0.0)
    f = table(s, d, "features").where("method_name is not null and label in (0, 1)")
    rows = materialize(f.groupBy("bug_id", "method_name").agg(F.max("label").cast("double").alias("label"), *[F.max(clean(c)).alias(c) for c in ("bfr", "brr", "cfs")]), "rows")
    model = M.fit_scorer(rows.where("bug_id % 2 = 1"), ["bfr", "brr", "cfs"])
    return R.metrics(M.score(model, rows.where("bug_id % 2 = 0")), "bug_id", "buggy_rate", "label", "method_name")


_STOPPED = "', '".join(w.replace("'", "") for w in STOP)
_PUNCT = PUNCTUATION.replace("'", "''")
_COUNTS = """ c AS (SELECT id, term, count(*) AS n FROM tok GROUP BY ALL), l AS (SELECT id, sum(n * n) AS norm FROM c GROUP BY ALL)"""
_COS = "round(s / sqrt((w * xx - (w - 1) * sx) * (w * yy - (w - 1) * sy)), 6)"

SQL = {
    "normalised_reports": rf"""SELECT row_id, array_to_string(list_filter(regexp_split_to_array(translate(lower(concat_ws(' ', summary, description)), '{_PUNCT}', ''), '\s+'), lambda x: x <> '' AND x NOT IN ('{_STOPPED}')), ' ') AS words FROM bug_reports""",
    "report_pair_cosine": f"""WITH tok AS (SELECT row_id AS id, lower(unnest(report)) AS term FROM bug_reports),{_COUNTS}, p AS (SELECT row_id AS a, row_id + 7 AS b FROM bug_reports),
 s AS (SELECT a, b, sum(x.n * y.n) AS s, sum(x.n * x.n) AS sx, sum(y.n * y.n) AS sy FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b AND x.term = y.term GROUP BY ALL)
 SELECT a, b, coalesce({_COS}, 0.0) AS score FROM p LEFT JOIN (SELECT s.*, lx.norm AS xx, ly.norm AS yy, power(ln(1.5) + 1, 2) AS w FROM s JOIN l lx ON lx.id = a JOIN l ly ON ly.id = b) q USING (a, b)""",
    "earlier_reports": rf"""WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bug_id ORDER BY loaded_at DESC, row_id DESC) AS rn FROM bug_reports) q WHERE rn = 1),
 r AS (SELECT bug_id AS id, report, CASE WHEN regexp_matches(s, '^\d{{1,12}}$') THEN make_timestamp(CAST(s AS BIGINT) * 1000000)
   WHEN s NOT LIKE '0000%' THEN try_cast(regexp_replace(s, '(Z|[+-]\d\d:\d\d)$', '') AS TIMESTAMP) - to_minutes(CASE WHEN regexp_matches(s, '[+-]\d\d:\d\d$')
    THEN (CASE WHEN s[-6] = '-' THEN -1 ELSE 1 END) * (CAST(s[-5:-4] AS BIGINT) * 60 + CAST(s[-2:] AS BIGINT)) ELSE 0 END) END AS ts FROM (SELECT *, replace(trim(commit_time, ' '), '/', '-') AS s FROM cur) q),
 tok AS (SELECT id, lower(unnest(report)) AS term FROM r WHERE ts IS NOT NULL),{_COUNTS},
 s AS (SELECT q.id AS query, t.id AS node, sum(x.n * y.n) AS s, sum(x.n * x.n) AS sx, sum(y.n * y.n) AS sy FROM r q JOIN c x ON x.id = q.id JOIN c y ON y.term = x.term JOIN r t ON t.id = y.id WHERE q.id % 50 = 0 AND t.ts < q.ts GROUP BY ALL),
 g AS (SELECT query, node, round(s / sqrt((w * xx - (w - 1) * sx) * (w * yy - (w - 1) * sy)), 9) AS score FROM (SELECT s.*, lx.norm AS xx, ly.norm AS yy, power(ln(1.5) + 1, 2) AS w FROM s JOIN l lx ON lx.id = query JOIN l ly ON ly.id = node) q)
 SELECT query, node, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node DESC) AS rn FROM g) q WHERE rn <= 50""",
    "ranked_results": """WITH f AS (SELECT bug_id, method_name, max(buggy_rate) AS p FROM features WHERE method_name IS NOT NULL AND buggy_rate >= 0 AND NOT isnan(buggy_rate) GROUP BY ALL)
 SELECT bug_id, CAST(row_number() OVER (PARTITION BY bug_id ORDER BY concat('(''', method_name, ''', ', format('{:.4f}', p), ')')) - 1 AS INTEGER) AS place, method_name AS uri, round(CAST(format('{:.4f}', p) AS DOUBLE), 4) AS probability FROM f""",
    "diff_lines": """WITH t AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE kind = 'code' AND text IS NOT NULL), u AS (SELECT id, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS x FROM t),
 k AS (SELECT id, pos, [' ', '-', '+', ' '][CAST((pos * 7 + length(x)) % 4 AS INTEGER) + 1] AS kind FROM u)
 SELECT id, pos, kind, CASE WHEN kind <> '+' THEN count(*) FILTER (WHERE kind <> '+') OVER w ELSE 0 END AS old_line, CASE WHEN kind <> '-' THEN count(*) FILTER (WHERE kind <> '-') OVER w ELSE 0 END AS new_line
 FROM k WINDOW w AS (PARTITION BY id ORDER BY pos)""",
    "version_changes": """WITH v AS (SELECT DISTINCT method_id, version, coalesce(op = 'DELETE', false) AS gone, coalesce(source_code, '') AS code FROM method_versions),
 o AS (SELECT method_id, code FROM (SELECT *, row_number() OVER (PARTITION BY method_id ORDER BY version DESC, gone DESC, code DESC) AS rn FROM v WHERE version <= 20) q WHERE rn = 1 AND NOT gone),
 n AS (SELECT method_id, code FROM (SELECT *, row_number() OVER (PARTITION BY method_id ORDER BY version DESC, gone DESC, code DESC) AS rn FROM v WHERE version <= 30) q WHERE rn = 1 AND NOT gone)
 SELECT method_id, CASE WHEN o.code IS NULL THEN 'ADD' WHEN n.code IS NULL THEN 'DELETE' ELSE 'MODIFY' END AS op FROM o FULL JOIN n USING (method_id) WHERE o.code IS DISTINCT FROM n.code""",
    "issue_filters": EVENTS_SQL
    + r""", names AS (SELECT hook_id, event_pos, bool_or(contains(coalesce(CASE json_type(x) WHEN 'OBJECT' THEN x ->> '$.name' ELSE x ->> '$' END, ''), 'bug')) AS bug FROM label WHERE json_type(x) <> 'NULL' GROUP BY ALL)
 SELECT ev.hook_id, ev.event_pos, coalesce(bug, false) AS bug, nullif(regexp_extract(string_split(title, '&')[-1], '^\s*commitId:\s*([0-9A-Za-z]+)\s*$', 1), '') AS commit FROM ev LEFT JOIN names USING (hook_id, event_pos)""",
    "staged_nodes": "SELECT uri, max(label) AS label, max(commit_id) AS \"commitID\", max(not_declared) AS \"notDeclared\" FROM method_versions GROUP BY uri HAVING count(label) + count(commit_id) + count(not_declared) > 0",
    "nearest_embeddings": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
 p AS (SELECT q.id AS query, n.id AS node, round(list_dot_product(q.v, n.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(n.v, n.v)), 9) AS score FROM v q JOIN v n ON q.id <> n.id WHERE q.id % 50 = 0)
 SELECT query, node, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node DESC) AS rn FROM p) q WHERE rn <= 10""",
    "neighbour_cosines": """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))
  * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
}

QUERIES = {
    **{name: globals()[name] for name in SQL},
    "stemmed_reports": stemmed_reports,
    "code_outlines": code_outlines,
    "learned_metrics": learned_metrics,
}
