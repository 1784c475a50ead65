import os

from basketry.session import fresh_path, staged, staging


def test_staged_tables_last_as_long_as_their_scope(spark):
    kept = fresh_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with staging(spark):
        table = staged(spark.range(5), "gone")
        path = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path) and spark.read.parquet(kept).count() == 3
