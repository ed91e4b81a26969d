from tracewell.operators.shred import entity, objects, shred


def test_tables_keep_their_links(spark):
    text = '[null, {"a": {"b": [{"c": "x", "d": 1}, null, {"d": 2}, "s"]}, "t": null}, 5, {"payload": "{\\"t\\": \\"in\\"}"}]'
    rows = [(1, text), (2, None), (3, ""), (4, "{"), (5, '{"t": NaN}'), (6, '{"payload": {"t": "é\\ud800"}}'), (7, "[" * 5000), (8, '{"a": {"b": {"c": "y"}}}'), (8, "[]")]
    nodes = shred(spark.createDataFrame(rows, "key bigint, j string"), "key", "j", wrapper="payload").cache()
    roots = sorted((r.key, r.root_pos, r.t) for r in entity(nodes, "", ["t"]).collect())
    assert roots == [(1, 1, None), (1, 3, "in"), (6, 0, "é?"), (8, 0, None)]
    b = sorted((r.key, r.pos, r.c, r.d, r.scalar) for r in entity(nodes, "a.b", ["c", "d"]).collect())
    assert b == [(1, 0, "x", "1", None), (1, 2, None, "2", None), (1, 3, None, None, "s"), (8, 0, "y", None, None)]
    a = {(r.key, r.node) for r in objects(nodes, "a").collect()}
    assert {(r.key, r.up) for r in objects(nodes, "a.b").collect()} == a


def test_kept_paths_give_the_same_entities(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [{"c": "x", "z": {"q": 1}}]}, "rest": [1, 2]}')], "key bigint, j string")
    pruned, whole = shred(df, "key", "j", paths=["a.b[].c"]), shred(df, "key", "j")
    assert [r.c for r in entity(pruned, "a.b", ["c"]).collect()] == [r.c for r in entity(whole, "a.b", ["c"]).collect()] == ["x"]
    assert pruned.count() < whole.count()


def test_empty_table(spark):
    assert shred(spark.createDataFrame([], "key bigint, j string"), "key", "j").count() == 0


def test_arrays_in_arrays_belong_to_their_object(spark):
    nodes = shred(spark.createDataFrame([(1, '{"a": [[{"x": 1}], [{"x": 2}]]}')], "key bigint, j string"), "key", "j")
    assert {(r.owner, r.ordinal) for r in nodes.where("path = 'a[][]'").collect()} == {(0, 0)}
