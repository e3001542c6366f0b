"""Numbering rows over all partitions, and cutting them into batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.tables import column

BUCKET_DIGITS = 4  # 16**4 = 65,536 buckets of the digest order


def with_position(df: DataFrame, name: str) -> DataFrame:
    """Add ``position``: the 0-based place of each row in ``(md5(name), name)`` order.

    A window over the whole table would sort it in one task. The leading digits
    of the digest split the order into 65,536 even buckets: rows are ranked inside
    their bucket, and each bucket starts where the earlier ones end. Only that
    table of bucket sizes, at most 65,536 rows, is summed in one place and
    broadcast. ``name`` should be free of repeats, as a repeated value is one
    bucket's work.
    """
    keyed = df.select("*", F.md5(column(name)).alias("_digest"))
    # Never NULL, so that the join adds no digest filter below what made ``df``, and
    # both uses of ``df`` stay the same plan, which Spark then runs once.
    bucket = F.coalesce(F.substring("_digest", 1, BUCKET_DIGITS), F.lit(""))
    keyed = keyed.withColumn("_bucket", bucket)
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_bucket"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", column(name))
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(starts), "_bucket").select(
        *[column(c) for c in df.columns], (F.col("_start") + F.col("_rank")).alias("position")
    )


def make_batches(responses: DataFrame, batch_size: int = 3, name: str = "response") -> DataFrame:
    """``(batch_id, responses)``: consecutive runs of ``batch_size`` distinct answers.

    The last batch may be short, and no answers give no batches.
    """
    if batch_size < 1:
        raise ValueError("a batch needs at least one answer")
    placed = with_position(responses.select(column(name).alias("response")).distinct(), "response")
    batch_id = F.floor(F.col("position") / batch_size).cast("long")
    members = F.sort_array(F.collect_list(F.struct("position", "response")))
    return (
        placed.groupBy(batch_id.alias("batch_id"))
        .agg(members.alias("_members"))
        .select("batch_id", F.col("_members.response").alias("responses"))
    )
