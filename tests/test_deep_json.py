import json

import pytest

from tracewell.operators.shred import _parsed_deep, shred


def test_deep_and_long_values_are_read(spark):
    deep, digits = "[" * 20_000 + "1" + "]" * 20_000, "9" * 5000
    rows = [(1, f'{{"t": "x", "rest": {deep}}}'), (2, f'{{"t": {digits}}}'), (3, f'{{"t": "y", "rest": {deep[:-1]}}}'), (4, f'{{"t": {digits}, "u": NaN}}')]
    nodes = shred(spark.createDataFrame(rows, "key bigint, j string"), "key", "j", paths=["t"]).where("path = 't'")
    assert sorted((r.key, r.kind, r.scalar) for r in nodes.collect()) == [(1, "string", "x"), (2, "scalar", digits)]


@pytest.mark.parametrize("text", [' {"a": [1, -2.5e3, {"b": [], "c": {}}, "x\\n\\u00e9", true, false, null], "a": [0]} ', "[]", "3", '"s"', "", "[1,]", '{"a" 1}', '{"a": 1,}', "[1 2]", "01", "[NaN]", "{}x", "-", "tru", '{"a": "b\n"}', "\ufeff1", "[[1], [2, [3]]]"])
def test_the_exact_parser_reads_what_python_reads(text):
    def read(f):
        try:
            return f(text)
        except ValueError:
            return "refused"

    def refuse(name):
        raise ValueError(name)

    assert read(_parsed_deep) == read(lambda t: json.loads(t, parse_constant=refuse))
