"""Prompt texts and their token estimate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording sent to the model.
CATEGORY_PROMPT = """List the {count} most relevant thematic categories for this sample of survey responses.
    Return only a JSON list of category names, in the format: `["name1", "name2", ...]`
    
    Question:
    `{question}`
    
    Responses:
    ```
    {sample}
    ```"""
CODING_PROMPT = """Categorize these responses to the following survey question using one {choice}of the provided categories.
    Return only a JSON list where each element is {element}for each response, in the format: {shape}.
    
    Question:
    `{question}`
    
    Responses:
    `{responses}`
    
    categories:
    ```
    {categories}
    ```"""
SINGLE_WORDING = {
    "choice": "",
    "element": "a category name ",
    "shape": '`["category for response 1", "category for response 2", ...]`',
}
MULTI_WORDING = {
    "choice": "or multiple ",
    "element": "a list of category names ",
    "shape": '`[["category 1 for response 1", "category 2 for response 1", ...], '
    '["category 1 for response 2", "category 2 for response 2", ...], ...]`',
}
PROMPT_OVERHEAD_TOKENS = 10


def _fill(template: str, slot: str, value: Column, **literals: object) -> Column:
    """``template`` with one slot taken from a column and the others from literals."""
    before, after = template.split("{" + slot + "}")
    return F.concat(F.lit(before.format(**literals)), value, F.lit(after.format(**literals)))


def category_prompt(sample: Column, question: str, count: int) -> Column:
    """Ask for ``count`` themes; ``sample`` is an array of cleaned answers."""
    listed = F.concat(F.lit("['"), F.array_join(sample, "', '"), F.lit("']"))
    listed = F.when(F.size(sample) == 0, F.lit("[]")).otherwise(listed)
    return _fill(CATEGORY_PROMPT, "sample", listed, count=count, question=question)


def coding_prompt(
    responses: Column, question: str, categories: Sequence[str], is_multicode: bool
) -> Column:
    """Ask for the codes of one batch; ``responses`` is an array of answers."""
    numbered = F.transform(
        responses, lambda text, i: F.concat((i + 1).cast("string"), F.lit(": "), text)
    )
    return _fill(
        CODING_PROMPT,
        "responses",
        F.array_join(numbered, "\n"),
        question=question,
        categories="\n".join(categories),
        **(MULTI_WORDING if is_multicode else SINGLE_WORDING),
    )


def estimate_tokens(prompt: Column) -> Column:
    """Tokens of a prompt at about four characters each, plus the message overhead."""
    return (F.ceil(F.length(prompt) / 4) + PROMPT_OVERHEAD_TOKENS).cast("long")


def token_counter(encoder_factory: Callable[[], Callable[[str], Sequence[int]]]):
    """A pandas UDF with exact counts, for when a tokenizer vocabulary is at hand.

    ``encoder_factory`` runs once per task and returns ``text -> token ids``.
    """

    @F.pandas_udf("long")
    def count_tokens(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder_factory()
        for batch in prompts:
            yield batch.map(lambda text: len(encode(text)) + PROMPT_OVERHEAD_TOKENS)

    return count_tokens
