"""Exact-size random samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.tables import column


def sample_array(df: DataFrame, name: str, n: int, seed: str) -> DataFrame:
    """One row with ``sample``: exactly ``n`` values in random but repeatable order.

    The rows with the smallest seeded digests are the sample, so Spark keeps the
    best ``n`` per task and merges those: no full sort, and the same seed gives
    the same sample whatever the partitioning. Fewer than ``n`` rows is an error,
    raised from the same pass.
    """
    ranked = df.select(F.md5(F.concat(F.lit(seed), column(name))).alias("_rank"), column(name).alias("_value"))
    best = ranked.orderBy("_rank", "_value").limit(n)
    rows = best.agg(F.sort_array(F.collect_list(F.struct("_rank", "_value"))).alias("_rows"))
    too_few = F.concat(F.lit(f"cannot sample {n} of "), F.size("_rows").cast("string"), F.lit(" rows"))
    checked = F.when(F.size("_rows") < n, F.raise_error(too_few)).otherwise(F.col("_rows._value"))
    return rows.select(checked.alias("sample"))


def sample_n(df: DataFrame, name: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of column ``name`` without replacement."""
    return sample_array(df, name, n, seed).select(F.explode("sample").alias(name))
