"""Small helpers shared by the operators: names, written tables, size checks."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name that may hold dots, spaces or backticks, ready for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


@functools.lru_cache(maxsize=None)
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="themeloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the session names it.

    Only a ``local`` session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder(spark.sparkContext.applicationId)


def _scratch_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/themeloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote by ``scratch_path``, once no result is read from it any more.

    Tables that were registered for their buckets are dropped too; those of other applications
    in the same catalog, which lie in folders of their own, stay.
    """
    for table in spark.catalog.listTables(pattern="themeloom_*"):
        details = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table.name)}").where("col_name = 'Location'").first()
        if details and f"/themeloom/{spark.sparkContext.applicationId}/" in details.data_type:
            spark.sql(f"DROP TABLE {quoted(table.name)}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(
    df: DataFrame, label: str, partition_by: str | None = None, texts: bool = False, page_rows: int | None = None
) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut.

    ``texts`` says that long texts are most of it, which zstd makes much smaller. ``page_rows`` is for a
    table that is sorted and read in runs: a read skips pages of that many rows, where the default of
    20,000 rows makes it read all of a row group.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if texts:
        writer = writer.option("compression", "zstd")
    if page_rows:
        writer = writer.option("parquet.page.row.count.limit", page_rows)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Bytes the rows of ``df`` take in memory, measured and not estimated."""
    row_overhead = 64
    width = F.lit(row_overhead)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(column(field.name)), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            text = F.array_join(column(field.name).cast("array<string>"), "")
            width = width + F.coalesce(F.octet_length(text), F.lit(0))
        else:
            width = width + F.lit(8)
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
