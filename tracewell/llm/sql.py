"""SQL that the queries of this subpackage are compared with."""

from __future__ import annotations

_NAMED = r"""
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

_PAIRS = f"""
WITH {_NAMED},
 n AS (SELECT method_id, count(*) AS n FROM named GROUP BY method_id),
 total AS (SELECT count(DISTINCT bug_id) AS n FROM named),
 both_ AS (SELECT x.method_id AS a, y.method_id AS b, count(*) AS n FROM named x JOIN named y ON x.bug_id = y.bug_id AND x.method_id < y.method_id GROUP BY ALL HAVING count(*) >= 8),
 kept AS (SELECT a, b, both_.n, both_.n * total.n / (na.n * nb.n) AS ratio FROM both_ JOIN n na ON na.method_id = a JOIN n nb ON nb.method_id = b, total
  WHERE both_.n * total.n >= 15 * na.n * nb.n),
 score AS (SELECT least(p.method_id, q.method_id) AS a, greatest(p.method_id, q.method_id) AS b, max(call_score) AS call_score
  FROM method_call_method m JOIN alias p ON m.id1 = p.id JOIN alias q ON m.id2 = q.id WHERE call_score IS NOT NULL AND NOT isnan(call_score) GROUP BY ALL)"""

_TERMS = """
WITH cur AS (SELECT bug_id, report FROM (SELECT *, row_number() OVER (PARTITION BY bug_id ORDER BY loaded_at DESC, row_id DESC) AS rn FROM bug_reports) q WHERE rn = 1),
 tok AS (SELECT bug_id, lower(unnest(report)) AS term FROM cur),
 tf AS (SELECT bug_id, term, count(*) AS tf FROM tok WHERE term IS NOT NULL GROUP BY ALL),
 len AS (SELECT bug_id, sum(tf) AS len FROM tf GROUP BY ALL),
 st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY ALL),
 tot AS (SELECT count(DISTINCT bug_id) AS n, CAST(sum(tf) AS DOUBLE) AS tokens FROM tf)"""

_FEATURES = """
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bug_id, method_name ORDER BY scored_at DESC) AS rn FROM features WHERE method_name IS NOT NULL) q WHERE rn = 1)"""

_TOP = (
    _FEATURES
    + """, top AS (SELECT bug_id, method_name, label, buggy_rate, CAST(row_number() OVER (PARTITION BY bug_id ORDER BY buggy_rate DESC, method_name DESC) AS INTEGER) AS rnk
  FROM cur WHERE label IN (0, 1) AND buggy_rate IS NOT NULL AND NOT isnan(buggy_rate))"""
)

_CROSS = """
WITH r AS (SELECT row_id, bug_id, source, list_sort(list_distinct(list_transform(coalesce(report, []), lambda x: lower(x)))) AS ts,
   CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'valid' THEN 'valid' WHEN 'validation' THEN 'valid' WHEN 'dev' THEN 'valid' WHEN 'test' THEN 'test' END AS side FROM bug_reports),
 t AS (SELECT row_id, len(ts) AS n, unnest(ts) AS term FROM r WHERE side = 'train' AND len(ts) >= 8),
 e AS (SELECT row_id, len(ts) AS n, unnest(ts) AS term FROM r WHERE side <> 'train' AND len(ts) >= 8),
 alike AS (SELECT t.row_id AS tr, e.row_id AS er FROM t JOIN e USING (term) GROUP BY t.row_id, e.row_id, t.n, e.n HAVING count(*) * 5 >= (t.n + e.n - count(*)) * 4),
 same AS (SELECT t.row_id AS tr, e.row_id AS er FROM r t JOIN r e ON t.bug_id = e.bug_id AND t.side = 'train' AND e.side <> 'train'),
 links AS (SELECT tr, er, max(s) AS same_bug FROM (SELECT tr, er, false AS s FROM alike UNION ALL SELECT tr, er, true FROM same) q GROUP BY ALL)"""

SQL = {
    "p1_found": _PAIRS + " SELECT a AS method_id_a, b AS method_id_b FROM kept JOIN score USING (a, b) WHERE call_score >= 0.5",
    "p1_pairs": _PAIRS + " SELECT a AS method_id_a, b AS method_id_b, n AS n_ab, round(ratio, 6) AS ratio, call_score FROM kept LEFT JOIN score USING (a, b)",
    "p3_found": _TERMS
    + """ SELECT bug_id, term FROM (SELECT bug_id, term, row_number() OVER (PARTITION BY bug_id ORDER BY round(tf * ln(n / df), 6) DESC, term) AS rn
  FROM tf JOIN st USING (term), tot WHERE df >= 2) q WHERE rn = 1""",
    "p3_scores": _TERMS
    + """, p AS (SELECT bug_id, term, tf, df, cf / tokens AS q, (tf + 500 * cf / tokens) / (len + 500) AS p FROM tf JOIN st USING (term) JOIN len USING (bug_id), tot WHERE df >= 2)
 SELECT bug_id, term, tf, df, round(p * ln(p / q), 6) + 0.0 AS score FROM p""",
    "p4_found": _FEATURES
    + """, s AS (SELECT bug_id, method_name, CASE WHEN bfr >= 0 AND NOT isnan(bfr) THEN bfr END AS b, CASE WHEN brr >= 0 AND NOT isnan(brr) THEN brr END AS r,
   CASE WHEN cfs >= 0 AND NOT isnan(cfs) THEN cfs END AS c, count(*) OVER (PARTITION BY bug_id) AS n FROM cur),
 p AS (SELECT bug_id, method_name, CASE WHEN b IS NULL THEN n + 1 ELSE rank() OVER (PARTITION BY bug_id ORDER BY b DESC NULLS LAST) END
   + CASE WHEN r IS NULL THEN n + 1 ELSE rank() OVER (PARTITION BY bug_id ORDER BY r DESC NULLS LAST) END
   + CASE WHEN c IS NULL THEN n + 1 ELSE rank() OVER (PARTITION BY bug_id ORDER BY c DESC NULLS LAST) END AS places FROM s)
 SELECT bug_id, rnk, method_name FROM (SELECT bug_id, method_name, CAST(row_number() OVER (PARTITION BY bug_id ORDER BY places, method_name DESC) AS INTEGER) AS rnk FROM p) q WHERE rnk <= 3""",
    "p4_ranking": _FEATURES
    + """, s AS (SELECT bug_id, method_name, k, CASE WHEN v >= 0 AND NOT isnan(v) THEN v END AS v FROM (SELECT bug_id, method_name, unnest(['b', 'r', 'c']) AS k, unnest([bfr, brr, cfs]) AS v FROM cur) q),
 o AS (SELECT *, row_number() OVER (PARTITION BY bug_id, k ORDER BY v NULLS LAST) AS rn, count(v) OVER (PARTITION BY bug_id, k) AS n FROM s),
 q AS (SELECT bug_id, k, max(v) FILTER (WHERE rn = greatest(1, ceil(n * CAST(0.01 AS DOUBLE)))) AS lo, max(v) FILTER (WHERE rn = greatest(1, ceil(n * CAST(0.99 AS DOUBLE)))) AS hi FROM o GROUP BY ALL),
 x AS (SELECT bug_id, method_name, k, coalesce(CASE WHEN v IS NOT NULL THEN greatest(least(v, hi), lo) END, lo, 0) AS x FROM s JOIN q USING (bug_id, k)),
 e AS (SELECT bug_id, k, sqrt(sum(x * x)) AS norm, max(x) AS hi, min(x) AS lo FROM x GROUP BY ALL),
 d AS (SELECT bug_id, method_name, sqrt(sum(CASE WHEN norm > 0 THEN power((x - hi) / norm, 2) ELSE 0 END)) AS up, sqrt(sum(CASE WHEN norm > 0 THEN power((x - lo) / norm, 2) ELSE 0 END)) AS down FROM x JOIN e USING (bug_id, k) GROUP BY ALL),
 c AS (SELECT bug_id, method_name, round(CASE WHEN up + down > 0 THEN down / (up + down) ELSE 0.5 END, 9) AS closeness FROM d)
 SELECT bug_id, method_name, closeness, row_number() OVER (PARTITION BY bug_id ORDER BY closeness DESC, method_name DESC) AS rnk FROM c""",
    "p6_found": _TOP + " SELECT bug_id, rnk, method_name FROM top WHERE rnk <= 5",
    "p6_top": _TOP + " SELECT * FROM top WHERE rnk <= 5",
    "p7_found": _CROSS + " SELECT least(tr, er) AS row_id_a, greatest(tr, er) AS row_id_b FROM links",
    "p7_counts": _CROSS
    + """ SELECT side AS split, source, count(*) AS n_rows, count(*) FILTER (WHERE same_bug) AS n_same_bug
  FROM (SELECT er, max(same_bug) AS same_bug FROM links GROUP BY er) q JOIN r ON r.row_id = er GROUP BY ALL""",
    "p7_overlaps": """
WITH r AS (SELECT row_id, bug_id, list_sort(list_distinct(list_transform(coalesce(report, []), lambda x: lower(x)))) AS ts,
   CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'valid' THEN 'valid' WHEN 'validation' THEN 'valid' WHEN 'dev' THEN 'valid' WHEN 'test' THEN 'test' END AS side FROM bug_reports),
 c AS (SELECT ts, min(row_id) AS id, len(ts) AS n, bool_or(side = 'train') AS tr, bool_or(side <> 'train') AS ev FROM r WHERE side IS NOT NULL AND len(ts) > 0 GROUP BY ts),
 w AS (SELECT id, n, tr, ev, unnest(ts) AS term FROM c WHERE n >= 8),
 l AS (SELECT a.id AS t, b.id AS e, true AS long FROM w a JOIN w b ON a.term = b.term AND a.tr AND b.ev GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 5 >= (a.n + b.n - count(*)) * 4
  UNION ALL SELECT id, id, false FROM c WHERE n < 8 AND tr AND ev),
 k AS (SELECT t AS id, true AS train, count(*) AS n_links, count(*) FILTER (WHERE long) AS n_long_links FROM l GROUP BY t UNION ALL SELECT e, false, count(*), count(*) FILTER (WHERE long) FROM l GROUP BY e),
 b AS (SELECT bug_id, bool_or(side = 'train') AS tr, bool_or(side <> 'train') AS ev FROM r WHERE side IS NOT NULL AND bug_id IS NOT NULL GROUP BY bug_id)
 SELECT row_id, side AS split, c.id AS class_id, coalesce(c.n, 0) AS n_terms, coalesce(n_links, 0) AS n_links, coalesce(n_long_links, 0) AS n_long_links, coalesce(CASE WHEN side = 'train' THEN b.ev ELSE b.tr END, false) AS same_bug
 FROM r LEFT JOIN c ON c.ts = r.ts LEFT JOIN k ON k.id = c.id AND k.train = (side = 'train') LEFT JOIN b ON b.bug_id = r.bug_id WHERE side IS NOT NULL""",
    # what must hold of containers and pieces, which SQL can't compute
    "p9_checks": "SELECT count(DISTINCT doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_gaps, true AS filled FROM documents",
    "p10_checks": "SELECT CAST(0 AS BIGINT) AS n_not_whole, CAST(0 AS BIGINT) AS n_long, CAST(0 AS BIGINT) AS n_apart, CAST(0 AS BIGINT) AS n_misnumbered, CAST(0 AS BIGINT) AS n_other_text",
}
