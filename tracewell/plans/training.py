"""Queries of the general training-data operators (p2, p5) and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_time, micros
from ..operators.current import canonical_map, current_rows, id_aliases, report_methods
from ..operators.pit import known_at
from ..operators.shred import entity, objects, shred
from ..session import materialize, table

EVENT_PATHS = [
    "action",
    "issue.title",
    "issue.user.login",
    "issue.labels.name",
    "issue.labels[].name",
    *[f"{c}.reactions{r}.content" for c in ("comment", "comments", "comments[]") for r in ("", "[]")],
]


def versions_at_report(spark: SparkSession, d: str) -> DataFrame:
    """(bug_id, at, entity, state): each report's methods with the version valid and known at its time."""
    reports = current_rows(table(spark, d, "bug_reports"), ["bug_id"], ["loaded_at", "row_id"], ["loaded_at", "row_id", "commit_time", "method"])
    timed = reports.withColumn("at", micros(clean_time(F.col("commit_time")))).where("at is not null")
    mapped = canonical_map(table(spark, d, "method_map"))
    events = materialize(report_methods(timed, mapped, ["bug_id", "at"]).withColumnRenamed("method_id", "entity"), "events")
    v = table(spark, d, "method_versions").withColumnRenamed("method_id", "id").join(id_aliases(mapped), "id")
    taken = micros(F.col("commit_time"))
    changes = v.select(
        F.col("method_id").alias("entity"),
        F.greatest(taken, F.coalesce(micros(F.col("known_at")), taken)).alias("known"),
        F.struct(taken.alias("since"), "version", "op", "label", "commit_id").alias("state"),
    )
    return known_at(events, changes)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = versions_at_report(spark, d).where("state.version is not null and not state.op <=> 'DELETE'")
    return found.select("bug_id", F.col("entity").alias("method_id"), F.col("state.version").alias("version"))


def p2_states(spark: SparkSession, d: str) -> DataFrame:
    """Every version found, deletions included, with its attributes."""
    return versions_at_report(spark, d).select("bug_id", F.col("entity").alias("method_id"), "state.version", "state.op", "state.label", "state.commit_id")


def issue_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Flat tables events, labels, comments and reactions of the issue payloads, linked by (key, root_pos) and node."""
    nodes = materialize(shred(table(spark, d, "view_issue"), "hook_id", "payload", wrapper="payload", paths=EVENT_PATHS), "nodes")
    event = ["key", "root_pos"]
    issues = entity(nodes, "issue", ["title"]).select(*event, "title")
    users = entity(nodes, "issue.user", ["login"]).select(*event, "login")
    events = entity(nodes, "", ["action"]).join(issues, event, "left").join(users, event, "left").select(*event, "login", "action", "title")
    labels = entity(nodes, "issue.labels", ["name"]).select(*event, "pos", F.coalesce("name", "scalar").alias("name"))
    comments = objects(nodes, "comments").unionByName(objects(nodes, "comment")).select(*event, "node", "pos")
    reactions = entity(nodes, "comment.reactions", ["content"])
    for path in ("comments.reactions", "comments[].reactions"):
        reactions = reactions.unionByName(entity(nodes, path, ["content"]))
    reactions = reactions.select(*event, F.col("up").alias("node"), F.col("pos").alias("pos"), F.coalesce("content", "scalar").alias("content"))
    return {"events": events, "labels": labels, "comments": comments, "reactions": reactions}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t, event = issue_tables(spark, d), ["key", "root_pos"]
    none = F.lit(-1)
    rows = t["events"].select(*event, F.lit("issue").alias("kind"), none.alias("parent_pos"), none.alias("pos"), F.lit("").alias("value"))
    rows = rows.unionByName(t["labels"].select(*event, F.lit("label").alias("kind"), none.alias("parent_pos"), "pos", F.col("name").alias("value")))
    placed = t["reactions"].join(t["comments"].withColumnRenamed("pos", "parent_pos"), [*event, "node"])
    rows = rows.unionByName(placed.select(*event, F.lit("reaction").alias("kind"), "parent_pos", "pos", F.col("content").alias("value")))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("login", "action", "title", "value")]
    return rows.join(t["events"], event).select(F.col("key").alias("hook_id"), F.col("root_pos").alias("event_pos"), "kind", "parent_pos", "pos", *text)


def p5_issues(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of issue events alone."""
    return issue_tables(spark, d)["events"].withColumnsRenamed({"key": "hook_id", "root_pos": "event_pos"})


# SQL that reads the tables the same way; a Python-side string only, so that the queries and the SQL share nothing.
CANON = r"""
 canon_map AS (
  SELECT id, regexp_replace(head, '/', '.', 'g') || regexp_replace(substr(s, length(head) + 1), '[^(),]*\.', '', 'g') AS uri FROM (
   SELECT id, s, regexp_extract(s, '^[^(]*') AS head FROM (
    SELECT id, regexp_replace(regexp_replace(method_uri, '\s+', '', 'g'), '#\d+$', '') AS s FROM method_map) q) q),
 uri_id AS (SELECT uri, min(id) AS method_id FROM canon_map GROUP BY uri),
 alias AS (SELECT id, min(method_id) AS method_id FROM canon_map JOIN uri_id USING (uri) GROUP BY id),
 cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bug_id ORDER BY loaded_at DESC, row_id DESC) AS rn FROM bug_reports) q WHERE rn = 1),
 entry AS (
  SELECT bug_id, regexp_replace(head, '/', '.', 'g') || regexp_replace(substr(s, length(head) + 1), '[^(),]*\.', '', 'g') AS uri FROM (
   SELECT bug_id, s, regexp_extract(s, '^[^(]*') AS head FROM (
    SELECT bug_id, regexp_replace(regexp_replace(substr(e, 2, length(e) - 2), '\s+', '', 'g'), '#\d+$', '') AS s FROM (
     SELECT bug_id, unnest(regexp_extract_all(method, '''[^'']*''|"[^"]*"')) AS e FROM cur) q) q) q),
 named AS (SELECT DISTINCT bug_id, method_id FROM entry JOIN uri_id USING (uri))"""

TIMED = r"""
 timed AS (SELECT bug_id, CASE WHEN regexp_matches(s, '^\d{1,12}$') THEN make_timestamp(CAST(s AS BIGINT) * 1000000)
   WHEN s NOT LIKE '0000%' THEN try_cast(regexp_replace(s, '(Z|[+-]\d\d:\d\d)$', '') AS TIMESTAMP)
     - to_minutes(CASE WHEN regexp_matches(s, '[+-]\d\d:\d\d$')
       THEN (CASE WHEN s[-6] = '-' THEN -1 ELSE 1 END) * (CAST(s[-5:-4] AS BIGINT) * 60 + CAST(s[-2:] AS BIGINT)) ELSE 0 END) END AS t
  FROM (SELECT bug_id, replace(trim(commit_time, ' '), '/', '-') AS s FROM cur) q)"""

_STATES = rf"""
WITH {CANON}, {TIMED},
 v AS (SELECT a.method_id, version, op, label, commit_id, commit_time AS ct, greatest(commit_time, coalesce(known_at, commit_time)) AS known
  FROM method_versions m JOIN alias a ON m.method_id = a.id),
 best AS (SELECT n.bug_id, n.method_id, version, op, label, commit_id,
   row_number() OVER (PARTITION BY n.bug_id, n.method_id ORDER BY ct DESC, version DESC, op DESC, label DESC NULLS LAST, commit_id DESC NULLS LAST) AS rn
  FROM named n JOIN timed USING (bug_id) JOIN v ON v.method_id = n.method_id AND known <= t)"""

EVENTS_SQL = r"""
WITH whole AS (SELECT hook_id, TRY_CAST(payload AS JSON) AS j FROM view_issue),
 outer_ AS (SELECT hook_id, CASE WHEN json_type(j) = 'OBJECT' AND json_keys(j) = ['payload'] THEN
    CASE json_type(j, '$.payload') WHEN 'VARCHAR' THEN TRY_CAST(j ->> '$.payload' AS JSON) ELSE j -> '$.payload' END ELSE j END AS j FROM whole WHERE j IS NOT NULL),
 many AS (SELECT hook_id, j, CASE json_type(j) WHEN 'ARRAY' THEN json_array_length(j) ELSE 1 END AS n FROM outer_ WHERE json_type(j) IN ('ARRAY', 'OBJECT')),
 each_ AS (SELECT hook_id, CAST(i AS INTEGER) AS event_pos, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[' || i || ']') ELSE j END AS e
  FROM (SELECT hook_id, j, unnest(range(CAST(n AS BIGINT))) AS i FROM many) q),
 ev AS (SELECT hook_id, event_pos, e, coalesce(e ->> '$.issue.user.login', '') AS login, coalesce(e ->> '$.action', '') AS action, coalesce(e ->> '$.issue.title', '') AS title
  FROM each_ WHERE json_type(e) = 'OBJECT'),
 listed AS (SELECT *, CASE json_type(l) WHEN 'ARRAY' THEN CAST(l AS JSON[]) WHEN 'NULL' THEN [] ELSE [l] END AS ls,
   CASE json_type(c) WHEN 'ARRAY' THEN CAST(c AS JSON[]) WHEN 'NULL' THEN [] ELSE [c] END || CASE json_type(o) WHEN 'OBJECT' THEN [o] ELSE [] END AS cs
  FROM (SELECT *, coalesce(e -> '$.issue.labels', 'null'::JSON) AS l, coalesce(e -> '$.comments', 'null'::JSON) AS c, coalesce(e -> '$.comment', 'null'::JSON) AS o FROM ev) q),
 label AS (SELECT hook_id, event_pos, login, action, title, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS x FROM listed),
 comment AS (SELECT hook_id, event_pos, login, action, title, CAST(unnest(range(len(cs))) AS INTEGER) AS parent_pos, unnest(cs) AS x FROM listed),
 reaction AS (SELECT hook_id, event_pos, login, action, title, parent_pos, CAST(unnest(range(len(rs))) AS INTEGER) AS pos, unnest(rs) AS x
  FROM (SELECT *, CASE json_type(r) WHEN 'ARRAY' THEN CAST(r AS JSON[]) WHEN 'NULL' THEN [] ELSE [r] END AS rs
   FROM (SELECT *, coalesce(x -> '$.reactions', 'null'::JSON) AS r FROM comment WHERE json_type(x) = 'OBJECT') q) q)"""

SQL = {
    "p2_found": _STATES + " SELECT bug_id, method_id, version FROM best WHERE rn = 1 AND op IS DISTINCT FROM 'DELETE'",
    "p2_states": _STATES + " SELECT bug_id, method_id, version, op, label, commit_id FROM best WHERE rn = 1",
    "p5_found": EVENTS_SQL
    + """
 SELECT hook_id, event_pos, 'issue' AS kind, -1 AS parent_pos, -1 AS pos, login, action, title, '' AS value FROM ev
 UNION ALL SELECT hook_id, event_pos, 'label', -1, pos, login, action, title, coalesce(CASE json_type(x) WHEN 'OBJECT' THEN x ->> '$.name' ELSE x ->> '$' END, '')
  FROM label WHERE json_type(x) <> 'NULL'
 UNION ALL SELECT hook_id, event_pos, 'reaction', parent_pos, pos, login, action, title, coalesce(CASE json_type(x) WHEN 'OBJECT' THEN x ->> '$.content' ELSE x ->> '$' END, '')
  FROM reaction WHERE json_type(x) <> 'NULL'""",
    "p5_issues": EVENTS_SQL
    + " SELECT hook_id, event_pos, e ->> '$.issue.user.login' AS login, e ->> '$.action' AS action, e ->> '$.issue.title' AS title FROM ev",
}

QUERIES = {"p2_found": p2_found, "p2_states": p2_states, "p5_found": p5_found, "p5_issues": p5_issues}
