"""Stripping, strict parsing and validation of stored model replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import trim_whitespace
from themeloom.tables import column

# What is deleted from a reply before it is parsed, in order.
REPLY_NOISE = ("json", "`", "\n")


def strip_reply(reply: Column, fence_only: bool = False) -> Column:
    """Trim, then delete every noise token anywhere.

    ``fence_only`` removes just an enclosing code fence, so that a category name
    holding one of the tokens survives.
    """
    reply = trim_whitespace(reply)
    if fence_only:
        reply = F.regexp_replace(reply, r"\A```(?:json)?\s*|\s*```\z", "")
        return F.replace(reply, F.lit("\n"), F.lit(""))
    for token in REPLY_NOISE:
        reply = F.replace(reply, F.lit(token), F.lit(""))
    return reply


def strict_json(text: Column) -> Column:
    """``text`` as a VARIANT, or NULL unless the whole of it is one JSON value.

    Spark's parser stops after the first value and ignores what follows. Wrapped
    in a list that ends with the digest of the text, only a single whole value
    leaves exactly two elements with the digest last.
    """
    digest = F.md5(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    whole = (F.size(as_list(wrapped)) == 2) & (F.try_variant_get(wrapped, "$[1]", "string") == digest)
    return F.when(F.coalesce(whole, F.lit(False)), F.variant_get(wrapped, "$[0]", "variant"))


def as_list(value: Column) -> Column:
    """A VARIANT as an array of its elements, NULL when it is no list."""
    return value.try_cast("array<variant>")


def as_strings(elements: Column) -> Column:
    return F.transform(elements, lambda e: e.try_cast("string"))


def _bad_group(elements: Column, categories: Column) -> Column:
    """Why a list of codes is not acceptable, NULL when it is."""
    not_text = F.exists(elements, lambda e: F.schema_of_variant(e) != "STRING")
    unknown = F.exists(elements, lambda e: ~F.array_contains(categories, e.try_cast("string")))
    return F.when(not_text, F.lit("not_a_string")).when(unknown, F.lit("unknown_category"))


def parse_category_list(df: DataFrame, reply: str, fence_only: bool = False) -> DataFrame:
    """Add ``valid`` and ``categories``: a reply is valid when it is a JSON list."""
    parsed = df.withColumn("_elements", as_list(strict_json(strip_reply(column(reply), fence_only))))
    return parsed.select(
        *[column(c) for c in df.columns],
        F.col("_elements").isNotNull().alias("valid"),
        as_strings(F.col("_elements")).alias("categories"),
    )


def validate_codes(
    df: DataFrame,
    reply: str,
    categories: Sequence[str],
    is_multicode: bool,
    fence_only: bool = False,
    expected: str | None = None,
) -> DataFrame:
    """Add ``valid``, ``reason`` (first failure) and ``codes`` (one list per answer).

    ``expected`` names a column with the number of answers asked about; with it a
    list of another length is invalid, without it the length is not looked at.
    """
    known = F.array(*[F.lit(c) for c in categories]).cast("array<string>")
    elements, groups = F.col("_elements"), F.col("_groups")
    parsed = df.withColumn("_json", strict_json(strip_reply(column(reply), fence_only)))
    parsed = parsed.withColumn("_elements", as_list(F.col("_json")))
    if is_multicode:
        parsed = parsed.withColumn("_groups", F.transform(elements, as_list))
        shape = F.exists(groups, lambda g: g.isNull())
        reasons = F.transform(groups, lambda g: _bad_group(g, known))
        content = F.try_element_at(F.filter(reasons, lambda r: r.isNotNull()), F.lit(1))
        codes = F.transform(groups, as_strings)
    else:
        shape = F.lit(False)
        content = _bad_group(elements, known)
        codes = F.transform(as_strings(elements), lambda c: F.array(c))
    length = F.lit(False) if expected is None else F.size(elements) != column(expected)
    parsed = parsed.withColumn(
        "reason",
        F.when(F.col("_json").isNull(), F.lit("not_json"))
        .when(elements.isNull(), F.lit("not_a_list"))
        .when(shape, F.lit("not_a_list_of_lists"))
        .when(content.isNotNull(), content)
        .when(length, F.lit("wrong_length")),
    )
    valid = F.col("reason").isNull()
    return parsed.select(
        *[column(c) for c in df.columns],
        valid.alias("valid"),
        F.col("reason"),
        F.when(valid, codes).alias("codes"),
    )
