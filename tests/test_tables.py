"""What is left behind when an application has cleared its scratch tables."""

from themeloom.tables import clear_scratch, scratch_path


def test_registered_tables_go_with_their_files(spark, tmp_path):
    rows = spark.range(10)
    for name, path in (("themeloom_own", scratch_path(spark, "own")), ("themeloom_other", str(tmp_path / "other"))):
        rows.write.bucketBy(2, "id").format("parquet").option("path", path).saveAsTable(name)
    try:
        clear_scratch(spark)
        assert [table.name for table in spark.catalog.listTables(pattern="themeloom_o*")] == ["themeloom_other"]
        assert spark.table("themeloom_other").count() == 10
    finally:
        spark.sql("DROP TABLE IF EXISTS themeloom_other")
