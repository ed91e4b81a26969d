from tracewell.plans import text_code


def test_a_deleted_method_is_gone(spark, tmp_path):
    rows = [(1, 5, "ADD", "a"), (1, 25, "DELETE", None), (2, 5, "ADD", "a"), (2, 10, "DELETE", None), (2, 25, "MODIFY", "b"), (9, 5, "ADD", "a"), (18, 25, "ADD", "a"), (3, 5, "ADD", "a"), (3, 22, "MODIFY", "b"), (4, 5, "ADD", "a"), (4, 9, "DELETE", None)]
    spark.createDataFrame(rows, "method_id bigint, version int, op string, source_code string").write.parquet(f"{tmp_path}/method_versions.parquet")
    found = {r.method_id: r.op for r in text_code.version_changes(spark, str(tmp_path)).collect()}
    assert found == {1: "DELETE", 2: "ADD", 3: "MODIFY", 18: "ADD"}
