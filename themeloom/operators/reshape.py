"""From the wide response table to distinct cleaned answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.config import UNCATEGORIZED
from themeloom.functions.text import clean_text
from themeloom.tables import column


def split_columns(df: DataFrame) -> tuple[str, list[str]]:
    """The id column and the response columns, by position."""
    id_column, *response_columns = df.columns
    return id_column, response_columns


def clean_responses(df: DataFrame) -> DataFrame:
    """Every response column cleaned, next to the untouched id: one projection."""
    id_column, response_columns = split_columns(df)
    kinds = dict(df.dtypes)

    def present(name: str) -> Column:
        """Numbers that are not a number are missing answers."""
        value = column(name)
        return F.when(~F.isnan(value), value) if kinds[name] in ("double", "float") else value

    cleaned = [clean_text(present(c)).alias(c) for c in response_columns]
    return df.select(column(id_column), *cleaned)


def unpivot_responses(df: DataFrame) -> DataFrame:
    """One row per present answer: ``(id, response_column, response)``."""
    id_column, response_columns = split_columns(df)
    long = df.unpivot(
        column(id_column), [column(c) for c in response_columns], "response_column", "response"
    )
    return long.where(F.col("response").isNotNull())


def distinct_responses(df: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Distinct present answers over all response columns.

    Tasks drop their own repeats before the shuffle, so an answer given by a
    third of all people reaches its reducer once per task.
    """
    answers = unpivot_responses(df).select("response")
    if not keep_empty:
        answers = answers.where(F.col("response") != "")
    return answers.distinct()


def promptable_rows(categories: DataFrame) -> DataFrame:
    """The rows of ``category`` a model may use: all but the helper one, which must be there."""
    helper = F.col("category") == UNCATEGORIZED
    present = categories.agg(F.coalesce(F.max(helper), F.lit(False))).scalar()
    missing = F.raise_error(F.lit(f"the categories must include {UNCATEGORIZED!r}")).cast("boolean")
    return categories.where(F.when(present, ~helper).otherwise(missing))


def promptable_categories(categories: list[str]) -> list[str]:
    """The same on names that are on the driver because prompts and columns are made of them."""
    if UNCATEGORIZED not in categories:
        raise ValueError(f"the categories must include {UNCATEGORIZED!r}")
    return [c for c in categories if c != UNCATEGORIZED]
