import json
from datetime import datetime

from tracewell import api
from tracewell.api import Engine
from tracewell.operators import model as M

A = """package p;
public class A extends Base {
    private B b; int n;
    public int f(B x, String s) { g(1); x.run(s); b.run("t"); Util.help(); new B(2); missing(); up(); return n; }
    private void g(int i) { if (i > 0) { System.out.println(i); } }
}
"""
B = "package p; class B { B(int i) {} void run(String s) {} interface I { void no(); } }"
BASE = "package p; class Base { void up() {} enum E { X } }"
UTIL = "package p.q; public final class Util { static void help() {} }"


def links(e, v=1):
    return {(r.src, r.rel, r.dst) for r in e.edges.collect() if r.rel != "update"}


def test_ingest_and_update(spark, tmp_path):
    src = tmp_path / "src"
    (src / "test").mkdir(parents=True)
    for name, code in (("A", A), ("B", B), ("Base", BASE), ("Util", UTIL)):
        (src / f"{name}.java").write_text(code)
    (src / "test" / "T.java").write_text("class T {}")
    e = Engine.empty(spark).ingest(str(src), "c1", ["test"])
    rows = {r.uri: r for r in e.nodes.collect()}
    assert {u for u, r in rows.items() if r.label == "Class"} == {"p.A#1", "p.B#1", "p.Base#1", "p.q.Util#1"}
    assert {u for u, r in rows.items() if r.label == "Variable"} == {"p.A-b#1", "p.A-n#1"}
    f = "p.A-f(B,String)#1"
    assert rows["p.B-B(int)#1"].is_constructor and not rows[f].is_constructor and "x.run(s)" in rows[f].source_code and rows[f].position.endswith("A.java:4")
    got = links(e)
    assert {d for s, r, d in got if s == f and r == "call"} == {"p.A-g(int)#1", "p.B-run(String)#1", "p.q.Util-help()#1", "A-missing(0)#1", "p.Base-up()#1"}
    assert rows["A-missing(0)#1"].label == "API" and rows["A-missing(0)#1"].not_declared
    assert {("p.A#1", "inheritance", "p.Base#1"), ("p.A#1", "has", f), ("p.A-b#1", "instanceof", "p.B#1"), (f, "has", f"{f[:-2]}-parameter-0#1"), (f"{f[:-2]}-parameter-0#1", "instanceof", "p.B#1")} <= got
    e.save(str(tmp_path / "graph"))
    (src / "B.java").write_text(B.replace("void run(String s) {}", "void run(String s) { more(); } void more() {}"))
    (src / "Util.java").unlink()
    api.main([str(tmp_path / "graph"), "ingest", str(src), "--commit", "c2", "--skip", "test"])
    g = Engine.load(spark, str(tmp_path / "graph"))
    d = {(r.change, r.kind, r.old_uri, r.new_uri) for r in g.diff("c2").collect()}
    assert d == {("UPDATE", "Method", "p.B-run(String)#1", "p.B-run(String)#2"), ("ADD", "Method", None, "p.B-more()#2"), ("DELETE", "Class", "p.q.Util#1", None)}
    calls = {(r.src, r.dst) for r in g.snapshot("c2")["calls"].collect()}
    assert ("p.B-run(String)#2", "p.B-more()#2") in calls and (f, "p.B-run(String)#2") in calls and not [c for c in calls if "Util" in c[1]]


def test_stages_and_saved_model(spark, tmp_path, capsys):
    features = [(b, m, int(m == b % 5), b % 4 > 0, b % 3 + (m == b % 5), 0.1 * m, float(m == b % 5) + 0.01 * m) for b in range(40) for m in range(5)]
    spark.createDataFrame(features, "bug_id bigint, method_id bigint, label int, train boolean, bff int, bfr double, cfs double").write.parquet(str(tmp_path / "features"))
    for stage in ("train", "test", "evaluate"):
        api.main([str(tmp_path), stage])
    out = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert out["n_groups"] == 10 and out["hit_1"] == 1.0


def test_localize(spark, tmp_path):
    at = datetime(2020, 1, 1)
    reports = spark.createDataFrame([(1, at, ["null", "pointer", "parser"]), (2, at, ["slow", "query"]), (3, datetime(2030, 1, 1), ["null", "pointer", "parser"])], "bug_id bigint, at timestamp_ntz, terms array<string>").cache()
    fixed = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "bug_id bigint, method_id bigint").cache()
    e = Engine.empty(spark)
    rows = e.localize("Null pointer", "in the parser", datetime(2021, 1, 1), reports, fixed).collect()
    assert {r.method_id for r in rows} == {10, 11} and all(r.bff == 1 and r.bfr == 1 / 13 and r.score == r.cfs > 0 for r in rows)
    assert e.localize("Null pointer", None, datetime(2021, 1, 1), reports, fixed, top=1).count() == 1


def test_vectors_of_a_sample_differ(spark):
    texts = spark.createDataFrame([(i, [f"w{i % 50}", f"v{i % 7}", "all"]) for i in range(2000)] + [(5000, []), (5001, None)], "id bigint, terms array<string>")
    v = M.word_vectors(texts, 8, vocabulary=100, max_rows=300)
    assert len({tuple(r.vector) for r in v.where("id < 5000").collect()}) > 100 and {tuple(r.vector) for r in v.where("id >= 5000").collect()} == {(0.0,) * 8}
