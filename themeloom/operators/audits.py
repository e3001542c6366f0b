"""Reports on a codeframe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.config import FAILED


def failed_answers(codeframe: DataFrame) -> DataFrame:
    """Codeframe rows whose answer could not be coded."""
    if "categories" in codeframe.columns:
        return codeframe.where(F.array_contains("categories", FAILED))
    return codeframe.where(F.col("category") == FAILED)


def unknown_codes(codeframe: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``(response, code)`` for every code that is not among the categories, missing ones too."""
    if "categories" in codeframe.columns:
        codes = codeframe.select("response", F.explode("categories").alias("code"))
    else:
        codes = codeframe.select("response", F.col("category").alias("code"))
    return codes.where(F.col("code").isNull() | ~F.col("code").isin(list(categories)))
