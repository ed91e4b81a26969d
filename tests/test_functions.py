from pyspark.sql import functions as F

from tracewell.functions.normalise import normal_words, stem
from tracewell.functions.text import clean_time, report_tokens, split_kind, terms
from tracewell.functions.uris import canonical_uri, method_list
from tracewell.operators.current import current_rows
from tracewell.streaming.hooks import is_bug, result_rows, title_commit


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_times(spark):
    got = column(spark, [" 2015/03/07 19:49:32 ", "2015-03-07T00:00:01Z", "2014-11-16 12:20:00+05:00", "2015-02-23T01:07:36-08:00", "1425686408", "2015-03-07", "0000-00-00 00:00:00", "unknown", "", None, "2015-13-40 00:00:00"], clean_time)
    assert [None if t is None else str(t) for t in got] == ["2015-03-07 19:49:32", "2015-03-07 00:00:01", "2014-11-16 07:20:00", "2015-02-23 09:07:36", "2015-03-07 00:00:08", "2015-03-07 00:00:00"] + [None] * 5


def test_times_in_another_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert str(column(spark, ["2015-03-07 19:49:32"], clean_time)[0]) == "2015-03-07 19:49:32"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_uris(spark):
    assert column(spark, ["a/b/C-f(java.lang.String, int)#12", " a.C-g() ", "a/b", None], canonical_uri) == ["a.b.C-f(String,int)", "a.C-g()", "a.b", None]
    lists = ["['a/C-f(x.Y,Z)', \"a.C-f(Y, Z)#3\",]", "[]", "nan", "", None]
    assert column(spark, lists, method_list) == [["a.C-f(Y,Z)"], [], [], [], []]


def test_tokens(spark):
    df = spark.createDataFrame([("A.b c", None), (None, "it's [x]"), (None, None), ("", "")], "s string, d string")
    assert [r[0] for r in df.select(report_tokens(F.col("s"), F.col("d"))).collect()] == [["A", "b", "c"], ["it", "s", "x"], [], []]
    assert column(spark, [["A", None, "b"], None], terms, "array<string>") == [["a", "b"], []]
    assert column(spark, [" Train", "DEV", "validation", "test ", "other", None], split_kind) == ["train", "valid", "valid", "test", None, None]


def test_normalised_words(spark):
    assert column(spark, ["The quick, quick FOX's!", None], normal_words) == [["quick", "quick", "foxs"], []]
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "relational": "relat", "happy": "happi", "electrical": "electr", "adjustment": "adjust", "controlling": "control", "rate": "rate"}
    assert {w: stem(w) for w in words} == words


def test_issue_functions(spark):
    assert column(spark, [[("bugfix",)], [("ui",), None], None], is_bug, "array<struct<name: string>>") == [True, False, False]
    assert column(spark, ["x &commitId:ab12", "x", "commitId:ab & y", None], title_commit) == ["ab12", None, None, None]
    r = result_rows(spark.createDataFrame([("[('p.A-f()', 0.951), ('p.B-g(int,String)', 0.9)]",)], "r string"), "r").collect()
    assert [(x.place, x.uri, x.probability) for x in r] == [(0, "p.A-f()", 0.951), (1, "p.B-g(int,String)", 0.9)]


def test_current_rows(spark):
    df = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 5, "b"), (1, 3, None, "c"), (2, 1, None, None), (None, 9, 9, "x"), (1, 2, 5, "b")], "k int, row_id int, t int, rn string")
    assert sorted(tuple(r) for r in current_rows(df, ["k"], ["t", "row_id"]).select("k", "t", "row_id", "rn").collect()) == [(1, 5, 2, "b"), (2, None, 1, None)]
    assert current_rows(df.limit(0), ["k"], ["t"]).count() == 0


def test_config(tmp_path):
    import pytest

    from tracewell.config import Config

    (tmp_path / "c").write_text("# where\nsource_dir = /a=b\n\nskip_dirs=test, doc*s\n")
    assert Config.read(str(tmp_path / "c")) == Config(source_dir="/a=b", skip_dirs=("test", "doc*s"))
    (tmp_path / "c").write_text("other=1")
    with pytest.raises(ValueError):
        Config.read(str(tmp_path / "c"))


def test_generics_of_any_depth(spark):
    from tracewell.functions.uris import strip_generics

    deep = "f(A<B<C<D<E<F<G>>>>>>,H)"
    rows = spark.createDataFrame([(deep,), ("a < b",), ("f()",), (None,)], "s string").select(strip_generics(F.col("s")).alias("s")).collect()
    assert [r.s for r in rows] == ["f(A,H)", "a < b", "f()", None]
