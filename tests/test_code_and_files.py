import json
import math

import pytest
from pyspark.sql import functions as F

from tracewell.operators import diffs as D
from tracewell.operators import java as J
from tracewell.operators import model as M
from tracewell.operators import ranking as R
from tracewell.sources import files, sinks
from tracewell.streaming.hooks import watch

JAVA = """package p;
public class A {
    // if (x) { not code }
    int f(String a,
          int b) {
        if (b > 0) { return "}".length(); } else { g(); }
        return 0;
    }
    void g() { for (int i = 0; i < 3; i++) { h(i); } }
}
"""


def test_outline():
    got = [(o["kind"], o["name"], o["first"], o["signature_end"], o["last"]) for o in J.java_outline(JAVA)]
    assert got == [("class", "A", 2, 2, 10), ("method", "f", 4, 5, 8), ("method", "g", 9, 9, 9)]
    assert J.java_outline(JAVA)[1]["tokens"].count("End") == 2
    assert J.java_outline("") == [] and [o["kind"] for o in J.java_outline("class {{{ (")] in ([], ["class"])


RICH = """package p.q;
import java.util.*;
@Deprecated
public abstract class A<T extends B> extends p.Base<T> implements I {
    private static final Map<String, List<Integer>> m = new HashMap<>() {{ put("a", f(1)); }}, n;
    int[] a, b[] = {1, 2};
    @Test(expected = Foo.class) public void f() { this.g(1, h(2, 3)).k(); new B().run(); super.f(); }
    @SuppressWarnings("x") void g(int a) {
    }
    public abstract <R> R h(final Map<String, R> x, int... ys) throws E;
    A(String s) { this(s, 1); }
    static { int q = 1; }
    enum K { X(1) { void z() {} }, Y; int v; K(int i) {} }
    interface L { int call(List<String>[] p); }
    @interface M { int value() default 3; }
    class N { Runnable r = () -> { g(4); }; }
}
"""


def test_outline_of_what_java_allows():
    got = J.java_outline(RICH)
    names = [(o["kind"], o["class_name"], o["name"]) for o in got]
    top = "p.q.A"
    assert names == [
        ("class", top, "A"), ("field", top, "m"), ("field", top, "n"), ("field", top, "a"), ("field", top, "b"), ("method", top, "f"), ("method", top, "g"), ("method", top, "h"), ("constructor", top, "A"),
        ("enum", top + "$K", "K"), ("field", top + "$K", "v"), ("constructor", top + "$K", "K"), ("interface", top + "$L", "L"), ("method", top + "$L", "call"), ("annotation", top + "$M", "M"), ("method", top + "$M", "value"),
        ("class", top + "$N", "N"), ("field", top + "$N", "r"),
    ]
    by = {(o["class_name"], o["name"], o["kind"]): o for o in got}
    assert by[top, "A", "class"]["super_name"] == "Base" and by[top, "A", "class"]["last"] == 17
    assert [(c["receiver"], c["name"], c["n_args"]) for c in by[top, "f", "method"]["calls"]] == [("this", "g", 2), ("", "h", 2), ("?", "k", 0), ("?", "run", 0), ("super", "f", 0)]
    h = by[top, "h", "method"]
    assert h["type"] == "R" and [(p["type"], p["name"]) for p in h["parameters"]] == [("Map", "x"), ("int[]", "ys")] and (h["first"], h["last"]) == (10, 10)
    assert by[top, "m", "field"]["type"] == "Map" and by[top, "b", "field"]["type"] == "int[][]" and by[top + "$L", "call", "method"]["parameters"] == [{"type": "List[]", "name": "p"}]
    assert by[top, "g", "method"]["first"] == 8 and by[top, "g", "method"]["last"] == 9


def test_statement_blocks():
    blocks = J.statement_blocks("{ int i = 0 ; if ( i > 0 ) { f ( ) ; } End return i ; }".split())
    assert [" ".join(b) for b in blocks] == ["{", "int i = 0 ;", "if ( i > 0 ) {", "f ( ) ;", "End", "return i ;"]


GIT = """diff --git a/x/A.java b/x/A.java
index 1..2 100644
--- a/x/A.java
+++ b/x/A.java
@@ -1,3 +1,3 @@ class A
 one
--- two
+++ two
 three
@@ -10 +10,2 @@
-ten
+ten
+eleven
\\ No newline at end of file
diff --git a/B.java b/C.java
similarity index 90%
rename from B.java
rename to C.java
--- a/B.java
+++ b/C.java
@@ -5,2 +5,1 @@
 five
-six
diff --git a/N.java b/N.java
new file mode 100644
--- /dev/null
+++ b/N.java
@@ -0,0 +1,1 @@
+new
"""


def test_diff_of_several_files(spark):
    lines = D.file_lines(spark.createDataFrame([(1, GIT), (2, None), (3, "--- a/P.java\t2020\n+++ b/P.java\n@@ -2,1 +2,1 @@\n-x\n+y\n--- a/Q.java\n+++ /dev/null\n@@ -1 +0,0 @@\n-q")], "id int, body string")).orderBy("id", "pos").collect()
    got = [(r.id, r.new_file or r.old_file, r.kind, r.old_line, r.new_line, r.content) for r in lines]
    assert got == [
        (1, "x/A.java", " ", 1, 1, "one"), (1, "x/A.java", "-", 2, None, "-- two"), (1, "x/A.java", "+", None, 2, "++ two"), (1, "x/A.java", " ", 3, 3, "three"),
        (1, "x/A.java", "-", 10, None, "ten"), (1, "x/A.java", "+", None, 10, "ten"), (1, "x/A.java", "+", None, 11, "eleven"),
        (1, "C.java", " ", 5, 5, "five"), (1, "C.java", "-", 6, None, "six"), (1, "N.java", "+", None, 1, "new"),
        (3, "P.java", "-", 2, None, "x"), (3, "P.java", "+", None, 2, "y"), (3, "Q.java", "-", 1, None, "q"),
    ]
    changes = {(r.old_file, r.new_file): (r.op, r.renamed) for r in D.file_changes(spark.createDataFrame(lines)).collect()}
    assert changes == {("x/A.java", "x/A.java"): ("MODIFY", False), ("B.java", "C.java"): ("MODIFY", True), (None, "N.java"): ("ADD", False), ("P.java", "P.java"): ("MODIFY", False), ("Q.java", None): ("DELETE", False)}


def test_states(spark):
    body = " a\n-void f() {\n+void f(int x) {\n-old\n+new\n }\n+void n() {\n+}\n-void d() {\n-}"
    lines = D.diff_lines(spark.createDataFrame([(1, body)], "id int, body string"))
    assert [(r.kind, r.old_line, r.new_line) for r in lines.orderBy("pos").collect()][:4] == [(" ", 1, 1), ("-", 2, None), ("+", None, 2), ("-", 3, None)]
    m = "id int, method string, first int, signature_end int, last int"
    old = spark.createDataFrame([(1, "f", 2, 2, 4), (1, "d", 5, 5, 6), (1, "a", 1, 1, 1)], m)
    new = spark.createDataFrame([(1, "f", 2, 2, 4), (1, "n", 5, 5, 6), (1, "a", 1, 1, 1)], m)
    assert {r.method: (r.state, r.op) for r in D.method_states(lines, old, new).collect()} == {"f": (3, "MODIFY"), "n": (5, "ADD"), "d": (4, "DELETE")}


def test_item_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "k int, v string")
    assert {r.k: r.op for r in D.item_changes(a, b, ["k"], "v").collect()} == {1: "DELETE", 2: "MODIFY", 4: "ADD"}


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text('bug_id,commit_id,summary,description,commit_time,method\n1,c,"a ""q""\nline",,2015-01-01 00:00:00,"[\'m()\']"\n')
    r = files.reports_csv(spark, str(tmp_path / "r.csv")).first()
    assert (r.bug_id, r.summary, r.description) == ("1", 'a "q"\nline', None)
    (tmp_path / "e.txt").write_text("1 2  x y 0.5 z\nbad line\n")
    assert [tuple(x) for x in files.edge_list(spark, str(tmp_path / "e.txt"), 4).collect()] == [(1, 2, 0.5)]
    (tmp_path / "m.txt").write_text("1 a b(c, d)\n1 second\n")
    assert [tuple(x) for x in files.id_map(spark, str(tmp_path / "m.txt")).collect()] == [(1, "a b(c, d)")]
    doc = {"methodMap": {"C": [{"propertys": {"uri": "u", "sourceCode": "1"}}, {"propertys": {"uri": "u", "sourceCode": "2"}}]}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    assert [tuple(x) for x in files.snapshot_methods(spark, str(tmp_path / "s.json")).collect()] == [("u", "2")]
    (tmp_path / "src/test").mkdir(parents=True)
    (tmp_path / "src/A.java").write_text("class A {}")
    (tmp_path / "src/test/B.java").write_text("class B {}")
    assert files.java_files(spark, str(tmp_path / "src"), ["src*test"]).count() == 1
    (tmp_path / "c.csv").write_text("pre_commit_id,commit_id\na,b\nb,c\n")
    assert [x.commit_id for x in files.commits_csv(spark, str(tmp_path / "c.csv")).orderBy("ord").collect()] == ["a", "b", "c"]


def test_order_of_several_files(spark, tmp_path):
    folder = tmp_path / "ids"
    folder.mkdir()
    (folder / "a.txt").write_text("1 first\n")
    (folder / "b.txt").write_text("1 second\n" + "".join(f"{i} x{i}\n" for i in range(2, 5000)))
    assert files.id_map(spark, str(folder)).where("id = 1").first().uri == "first"  # though the larger file is read first


def test_commit_lists(spark, tmp_path):
    order = lambda df: [r.commit_id for r in df.orderBy("ord").collect()]
    (tmp_path / "db").write_text("1,b3,f3,x\n2,b2,b3,x\n3,b1,f1,x\n")
    assert order(files.commit_db(spark, str(tmp_path / "db"))) == ["f1", "b3", "f3"]
    (tmp_path / "x.csv").write_text("".join(f"a,b,c,d,e,f,{c}\n" for c in ("1234567zz", "abcdefgh", "1234567aa", "old")))
    assert order(files.commit_column(spark, str(tmp_path / "x.csv"))) == ["old", "1234567aa", "abcdefgh"]
    (tmp_path / "log").write_text("commit 2222222\nAuthor: a\nDate:   Tue Mar 3 10:00:00 2020 +0200\n\n    commit message\n\ncommit 1111111\nMerge: 1 2\nDate:   Mon Mar 2 09:00:00 2020 +0000\n")
    assert [(r.ord, r.commit_id, str(r.time)) for r in files.git_log(spark, str(tmp_path / "log")).orderBy("ord").collect()] == [(0, "1111111", "2020-03-02 09:00:00"), (1, "2222222", "2020-03-03 08:00:00")]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("u", "label", "Method", True, 1), ("u", "commitID", "a", True, 1), ("u", "commitID", "b", True, 2), ("u", "call", "w", False, 3), ("u", "call", "w", False, 4)], "s string, p string, o string, is_literal boolean, seq int")
    nodes, edges = sinks.pivot_triples(t)
    assert (nodes.first().commitID, nodes.first().position, edges.count()) == ("b", None, 1)
    sinks.write_csv(edges, str(tmp_path / "edges"))
    assert files.edges_csv(spark, str(tmp_path / "edges")).first().relation == "call"
    sinks.append_lines(edges, str(tmp_path / "log"))
    sinks.append_lines(edges, str(tmp_path / "log"))
    assert files.first_json_row(spark, str(tmp_path / "log"), files.EDGE_CSV, node2="w").count() == 1
    doc = sinks.snapshot_json(spark.createDataFrame([("C", "u", "code")], "class_uri string, uri string, code string")).first().doc
    assert json.loads(doc)["methodMap"]["C"][0]["propertys"]["uri"] == "u"


def test_stream(spark, tmp_path):
    bug = json.dumps({"action": "opened", "issue": {"number": 1, "title": "t &commitId:abc", "body": "b", "labels": [{"name": "bugfix"}]}, "repository": {"name": "r"}})
    rows = [(1, bug), (1, bug), (2, bug.replace("opened", "closed")), (3, "{"), (4, None)]
    spark.createDataFrame(rows, "hook_id bigint, payload string").select("hook_id", F.current_timestamp().alias("delivered_at"), "payload").write.parquet(str(tmp_path / "in"))
    seen = []
    watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, n: seen.extend(df.collect())).awaitTermination(120)
    assert [(r.repo, r.number, r.commit) for r in seen] == [("r", 1, "abc")]


def test_model(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), float(i % 2), float(i % 2)) for i in range(200)], "k int, bfr double, bff double, cfs double, label double")
    for hidden in (0, 4):
        scored = M.score(M.fit_scorer(rows, hidden=hidden, iterations=50), rows)
        assert scored.where("(buggy_rate > 0.5) = (label = 1)").count() > 190
    v = M.word_vectors(spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "id int, terms array<string>"), 8).collect()
    assert len(v) == 3 and all(len(r.vector) == 8 for r in v)


def test_a_scorer_is_fitted_on_all_rows(spark):
    rows = spark.range(1_200_000).selectExpr("0D as bfr", "0D as bff", "0D as cfs", "double(id % 4 = 0) as label")
    assert abs(M.fit_scorer(rows).stages[-1].intercept + math.log(3)) < 1e-9  # the rate of label 1 among all of them


def test_weighted_rows_count_like_copies(spark):
    rows = spark.range(2000).selectExpr("id % 7 / 7 as bfr", "id % 3 * 1D as bff", "id % 11 / 3 as cfs", "double(pmod(xxhash64(id), 40) < id % 7) as label")
    copied = M.fit_scorer(R.oversample(rows, F.col("label") == 1, 300), iterations=100).stages[-1]
    weighed = M.fit_scorer(rows.withColumn("w", F.when(F.col("label") == 1, 301).otherwise(1)), iterations=100, weight="w").stages[-1]
    assert weighed.coefficients.toArray() == pytest.approx(copied.coefficients.toArray(), abs=1e-4) and weighed.intercept == pytest.approx(copied.intercept, abs=1e-4)
    assert M.fit_scorer(rows.withColumn("w", F.lit(2)), hidden=3, iterations=5, weight="w").transform(rows).count() == 2000
