import pytest

from pyspark.sql import functions as F

from tracewell.api import Engine
from tracewell.operators import graph as G
from tracewell.operators import snapshot as S

NODE = "uri string, relative_uri string, version int, label string, commit_id string, not_declared boolean, deleted_ver int, chain_root string, chain_pos int"


def node(rel, v, root=None, pos=1, deleted=None):
    return (f"{rel}#{v}", rel, v, "Method", f"c{v}", False, deleted, root or f"{rel}#{v}", pos)


def uris(df, c="uri"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [node("A-f()", 9), node("A-f()", 10, "A-f()#9", 2), node("D-g()", 1), node("D-g()", 2, "D-g()#1", 2, 3), node("B", 5), node("Foo", 1), node("BarFoo", 2)]
    return spark.createDataFrame(rows, NODE).cache()


def test_snapshots(nodes):
    assert "A-f()#10" in uris(G.newest_at(nodes, 10)) and "A-f()#9" in uris(G.newest_at(nodes, 9))
    assert "D-g()#2" in uris(G.newest_at(nodes, 2)) and not [u for u in uris(G.newest_at(nodes, 3)) if u.startswith("D")]
    assert "B#5" not in uris(G.newest_at(nodes, 4)) and "B#5" in uris(G.newest_at(nodes, 5))
    assert {r.relative_uri: r.uri for r in G.latest(nodes).collect()}["Foo"] == "Foo#1"


def test_diff_leads_from_one_snapshot_to_the_next(nodes):
    for v in range(1, 12):
        assert uris(G.apply_diff(G.newest_at(nodes, v - 1), G.diff_versions(nodes, v))) == uris(G.newest_at(nodes, v))


def test_two_replacements(spark, nodes):
    refs = spark.createDataFrame([("X", "A-f()#9"), ("X", "D-g()#1")], "src string, dst string")
    assert uris(G.replaced_at(nodes, refs, "dst", 2), "dst") == ["D-g()#2"]
    assert uris(G.replaced_at(nodes, refs, "dst", 10), "dst") == ["A-f()#10"]


def test_similar_edges(spark):
    n = spark.createDataFrame([node("A", 1), node("A", 4), node("B", 2), node("B", 3)], NODE)
    pairs = spark.createDataFrame([("A", "B")], "rel_a string, rel_b string")
    assert sorted((r.src, r.dst) for r in G.similar_edges(n, pairs).collect()) == [("A#1", "B#2"), ("A#1", "B#3"), ("A#4", "B#3")]
    one = spark.createDataFrame([node("A", 1), node("B", 1)], NODE)
    assert G.similar_edges(one, pairs).count() == 1


def test_chains_deeper_than_a_hundred(spark):
    e = spark.createDataFrame([(f"n{i}", "update", f"n{i + 1}") for i in range(150)], "src string, rel string, dst string")
    got = {r.uri: (r.root, r.pos) for r in G.chain_roots(e).collect()}
    assert len(got) == 151 and got["n150"] == ("n0", 151)


def test_commit_lookup_and_versions(spark):
    v = spark.createDataFrame([(1, "abcdefg1"), (2, "abcdefg2")], "version int, commit_id string")
    assert [G.version_of(v, c) for c in ("abcdefg", "abcdefg2", "zzz")] == [1, 2, -1]
    assert G.register_versions(v, v.unionByName(spark.createDataFrame([(3, "x"), (4, "x")], v.schema))).count() == 3


def test_engine(spark, nodes):
    owner = spark.createDataFrame([(*node("C", 1)[:3], "Class", *node("C", 1)[4:])], NODE)
    edges = spark.createDataFrame([("A-f()#9", "call", "Foo#1"), ("C#1", "has", "A-f()#9")], "src string, rel string, dst string")
    nodes = nodes.unionByName(owner)
    versions = spark.createDataFrame([(i, f"commit{i:04}") for i in range(1, 11)], "version int, commit_id string")
    e = Engine(spark, nodes, edges, versions)
    assert uris(e.snapshot("commit0010")["members"]) == ["A-f()#10"]
    changes = spark.createDataFrame([("A-f()", "MODIFY", "A-h()", None), ("Foo", "DELETE", None, None), ("N-n()", "ADD", None, "Method"), ("gone", "DELETE", None, None)], "relative_uri string, op string, new_relative_uri string, label string")
    f = e.update(changes, "commit0011")
    now = uris(f.snapshot("commit0011")["nodes"])
    assert "A-h()#11" in now and "N-n()#11" in now and "Foo#1" not in now and "A-f()#10" not in now
    assert f.triples().where("line = 'A-f()#10\tupdate\tA-h()#11'").count() == 1
    assert e.sql("select count(*) as n from nodes where version > 4").first().n == 3
    assert f.metadata().first().n_versions == 11
    for bad in ("drop table nodes", "insert into nodes select 1", "with x as (select 1) insert into nodes select * from x"):
        with pytest.raises(ValueError):
            e.sql(bad)
    with pytest.raises(ValueError):
        e.diff("commit0001")


def test_saved_graphs_survive_updates(spark, nodes, tmp_path):
    folder = str(tmp_path / "g")
    edges = spark.createDataFrame([("A-f()#9", "call", "Foo#1")], "src string, rel string, dst string")
    Engine(spark, nodes, edges, spark.createDataFrame([(i, f"commit{i:04}") for i in range(1, 11)], "version int, commit_id string")).save(folder)
    changes = spark.createDataFrame([("Foo", "DELETE", None, None)], "relative_uri string, op string, new_relative_uri string, label string")
    for i in (11, 12, 13):
        e = Engine.load(spark, folder)
        e.update(changes, f"commit{i:04}").save(folder)
        assert e.versions.count() == i - 1  # who still reads the graph before can
    last = Engine.load(spark, folder)
    assert last.versions.count() == 13 and "Foo#1" not in uris(last.snapshot("commit0013")["nodes"]) and last.edges.count() == 1
    assert len(list((tmp_path / "g").glob("0*-*"))) == 2
    last.add_similar(spark.createDataFrame([("BarFoo", "B")], "rel_a string, rel_b string")).save(folder)
    assert Engine.load(spark, folder).metadata().first().n_similar == 1


CHANGE = "relative_uri string, op string, new_relative_uri string, label string, class_uri string"


def test_random_histories_of_classes_and_members(spark):
    import random

    rng = random.Random(11)
    e, live, seen = Engine.empty(spark), {}, 0  # live: class name -> {member name: kind}
    states = {}
    for v in range(1, 6):
        changes, names = [], list(live)
        for c in rng.sample(names, min(len(names), 3)):
            op = rng.choice(["rename", "delete", "member", "member"])
            if op == "rename":
                changes.append((c, "MODIFY", f"R{v}{c}", None, None))
                live[f"R{v}{c}"] = live.pop(c)
                c = f"R{v}{c}"
            elif op == "delete":
                changes.append((c, "DELETE", None, None, None))
                del live[c]
                continue
            for m in rng.sample(sorted(live[c]), min(1, len(live[c]))):
                if rng.random() < 0.5:
                    changes.append((m, "MODIFY", None, None, None))
                else:
                    changes.append((m, "DELETE", None, None, None))
                    del live[c][m]
            changes.append((f"m{seen}", "ADD", None, "Method", c))
            live[c][f"m{seen}"] = "Method"
            seen += 1
        for _ in range(2):
            changes.append((f"C{seen}", "ADD", None, "Class", None))
            live[f"C{seen}"] = {}
            for kind in ("Method", "Variable"):
                changes.append((f"x{seen}{kind}", "ADD", None, kind, f"C{seen}"))
                live[f"C{seen}"][f"x{seen}{kind}"] = kind
            seen += 1
        e = e.update(spark.createDataFrame(changes, CHANGE), f"commit{v:04}")
        states[v] = {(c, m, k) for c, ms in live.items() for m, k in [*ms.items(), (c, "Class")]}
    e = Engine(spark, e.nodes.cache(), e.edges.cache(), e.versions)
    at = lambda v: S.members_at(e.nodes, e.edges, v)
    for v, want in states.items():
        got = at(v).collect()
        assert {(r.class_uri.split("#")[0], r.uri.split("#")[0], r.kind) for r in got} == want and len(got) == len(want)
        d = S.diff_members(e.nodes, e.edges, v).cache()
        rows = lambda df: sorted((r.class_uri, r.kind, r.uri) for r in df.collect())
        assert rows(S.apply_members(at(v - 1), d)) == rows(at(v))
        reported = e.diff(f"commit{v:04}").collect() if v > 1 else []
        assert not {r.new_uri for r in reported if r.kind == "Method"} & {r.new_uri for r in d.where("within").collect()} - {None}


def test_links_of_updates_and_detail(spark):
    changes = [("A", "ADD", None, "Class", None), ("B", "ADD", None, "Class", None), ("A-f()", "ADD", None, "Method", "A"), ("A-g()", "ADD", None, "Method", "A"), ("A-f()-parameter-0", "ADD", None, "Parameter", None)]
    links = [("A-f()", "call", "A-g()"), ("A-f()", "call", "java.print"), ("A-f()", "call", "A-g()"), ("A-f()", "has", "A-f()-parameter-0"), ("A-f()-parameter-0", "instanceof", "B"), ("A-f()", "returnType", "B"), ("A-f()", "returnType", "nowhere")]
    e = Engine.empty(spark).update(spark.createDataFrame(changes, CHANGE), "c1", spark.createDataFrame(links, "relative_uri string, rel string, target string"))
    e = e.update(spark.createDataFrame([("A-g()", "MODIFY", None, None, None), ("B", "MODIFY", "D", None, None)], CHANGE), "c2")
    graph = lambda c, detail: {(r.uri, r.rel, r.via, r.target) for r in e.snapshot(c, detail)["graph"].collect()}
    assert graph("c1", False) == {("A-f()#1", "call", None, "A-g()#1"), ("A-f()#1", "call", None, "java.print#1")}
    assert graph("c2", True) == {("A-f()#1", "call", None, "A-g()#2"), ("A-f()#1", "call", None, "java.print#1"), ("A-f()#1", "returnType", None, "D#2"), ("A-f()#1", "Parameter", "A-f()-parameter-0#1", "D#2")}
    lines = {r.line for r in e.snapshot_triples("c2").collect()}
    assert {"A#1\thas\tA-g()#2", "java.print#1\tlabel\tAPI", "D#2\tlabel\tClass", "A-f()#1\tcall\tA-g()#2"} <= lines
    assert [r.dst for r in e.relations("A-f()#1", ["call"]).orderBy("dst").collect()] == ["A-g()#1", "java.print#1"]
    assert [tuple(r) for r in S.grouped(S.sub_graph(e.nodes, e.edges, e.nodes, 1)).collect()][0][0] == "A-f()#1"


def test_members_of_deleted_classes_and_repeated_calls(spark):
    e = Engine.empty(spark).update(spark.createDataFrame([("A", "ADD", None, "Class", None), ("A-f()", "ADD", None, "Method", "A"), ("B", "ADD", None, "Class", None), ("B-g()", "ADD", None, "Method", "B")], CHANGE), "c1", spark.createDataFrame([("B-g()", "call", "A-f()")], "relative_uri string, rel string, target string"))
    e = e.update(spark.createDataFrame([("A-f()", "MODIFY", None, None, None)], CHANGE), "c2")
    e = Engine(spark, e.nodes, G.upsert_edges(e.edges, spark.createDataFrame([("B-g()#1", "call", "A-f()#2")], "src string, rel string, dst string")), e.versions)
    assert e.snapshot("c2")["calls"].count() == 1
    f = e.update(spark.createDataFrame([("A", "DELETE", None, None, None)], CHANGE), "c3")
    assert uris(f.snapshot("c3")["members"]) == ["B-g()#1"] and uris(f.snapshot("c3")["classes"]) == ["B#1"]


def test_labels_add_up(spark):
    stored = spark.createDataFrame([("u", "x", ["Method"]), ("w", "y", None)], "uri string, p string, labels array<string>")
    t = spark.createDataFrame([("u", "label", "Resource", 1), ("u", "p", "z", 2), ("n", "label", "Class", 3)], "uri string, property string, value string, seq int")
    renamed = t.withColumn("property", F.when(F.col("property") == "label", "labels").otherwise(F.col("property")))
    assert {r.uri: (r.p, r.labels) for r in G.upsert_nodes(stored, renamed, ["p"], "labels").collect()} == {"u": ("z", ["Method", "Resource"]), "w": ("y", []), "n": (None, ["Class"])}
