import os

from tracewell.session import clear, materialize, shared_dir


def test_stored_tables_keep_schema_and_can_be_cleared(spark):
    df = spark.createDataFrame([(1, ["a"], None)], "k int, a array<string>, s string")
    stored = materialize(df, "t")
    assert stored.schema == df.schema and stored.collect() == df.collect()
    folder = os.path.join(shared_dir(spark).removeprefix("file:"), "tracewell", spark.sparkContext.applicationId)
    assert os.listdir(folder)
    clear(spark)
    assert not os.path.exists(folder)
