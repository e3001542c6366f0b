"""The three jobs: propose categories, build a codeframe, apply it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.clients import ChatClient, ModelClient
from themeloom.config import DEFAULT_CATEGORIES, FAILED, CodingSettings
from themeloom.functions.prompts import category_prompt
from themeloom.operators.audits import failed_answers, unknown_codes
from themeloom.operators.batching import make_batches
from themeloom.operators.coding import build_codeframe
from themeloom.operators.indicators import categorize
from themeloom.operators.inference import (
    CodeReply,
    ThemeReply,
    coding_requests,
    run_requests,
    with_request,
)
from themeloom.operators.reshape import clean_responses, distinct_responses, promptable_categories
from themeloom.operators.sampling import sample_array
from themeloom.sources.csv_tables import read_categories, read_codeframe_multi, read_codeframe_single
from themeloom.tables import materialize, scratch_path


def _ledger_path(spark: SparkSession, path: str | None, client_factory: Callable[[], ModelClient], label: str) -> str:
    """Where replies are kept; those of a hosted model are paid for, so not among scratch tables."""
    if path is None and getattr(client_factory, "func", client_factory) is ChatClient:
        raise ValueError("give a ledger path for a hosted model, so that paid replies outlive the job")
    return path or scratch_path(spark, label)


def _theme_requests(sample: DataFrame, prompt_of: Callable[[Column], Column], settings: CodingSettings) -> DataFrame:
    """The requests for one row of answers, halved in order until each is under the token limit or one answer."""
    batches = sample.select(F.lit(0).cast("long").alias("batch_id"), F.col("sample").alias("responses"))
    while True:
        requests = with_request(batches, prompt_of, settings, split=False)
        over = (F.col("cost") > settings.tokens_per_minute) & (F.col("answers") > 1)
        if requests.where(over).isEmpty():
            return requests
        half = F.ceil(F.col("answers") / 2).cast("int")
        first, second = F.slice("responses", F.lit(1), half), F.slice("responses", half + 1, F.col("answers") - half)
        halves = F.when(over, F.array(first, second)).otherwise(F.array("responses"))
        parts = requests.select("batch_id", F.posexplode(halves).alias("half", "responses"))
        batches = parts.select((2 * F.col("batch_id") + F.col("half")).alias("batch_id"), "responses")


def _themes(
    sample: DataFrame,
    client_factory: Callable[[], ModelClient],
    settings: CodingSettings,
    ledger_path: str,
    start_full: bool = True,
) -> DataFrame:
    """One row with ``themes`` in the order of the sample, and whether any request ``failed``."""

    def prompt_of(responses: Column) -> Column:
        return category_prompt(responses, settings.question, settings.number_of_categories)

    requests = _theme_requests(sample, prompt_of, settings)
    requests = requests.withColumn("chars", F.length(F.array_join("responses", "")))
    ledger = run_requests(requests, client_factory, ThemeReply(), settings, ledger_path, start_full)
    replies = requests.select("request_key", "batch_id", "chars").join(ledger, "request_key")
    replies = replies.agg(F.sort_array(F.collect_list(F.struct("batch_id", "status", "codes", "chars"))).alias("parts"))
    good = F.filter("parts", lambda part: part["status"] == "ok")
    named = F.flatten(F.transform(good, lambda part: F.flatten(part["codes"])))
    found = replies.where(F.size("parts") > 0).select(
        F.when(F.size("parts") > 1, F.array_distinct(named)).otherwise(named).alias("themes"),
        F.exists("parts", lambda part: part["status"] != "ok").alias("failed"),
        F.size("parts").alias("parts"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda total, part: total + part["chars"]).alias("chars"),
    )
    shorter = (F.length(F.array_join("themes", "")) < F.col("chars")).alias("shorter")
    row = found.select("parts", F.size("themes").alias("size"), shorter).first()
    if row and row["parts"] > 1 and row["size"] > settings.number_of_categories and row["shorter"]:
        # The parts propose more than asked for: the model chooses among the themes of all parts, as
        # long as these grow shorter; then all stay. Written, as Spark takes scans of the ledger at
        # different times for the same within one plan.
        found = materialize(found, "themes")
        sample = found.select(F.col("themes").alias("sample"))
        chosen = _themes(sample, client_factory, settings, ledger_path, start_full=False)
        chosen = chosen.select(F.col("themes").alias("chosen"), F.col("failed").alias("not_chosen"))
        found = found.crossJoin(chosen).select(
            F.when(F.col("not_chosen"), F.col("themes")).otherwise(F.col("chosen")).alias("themes"), "failed"
        )
    return found.select("themes", "failed")


def propose_categories(
    sample: DataFrame,
    client_factory: Callable[[], ModelClient],
    settings: CodingSettings,
    ledger_path: str | None = None,
) -> DataFrame:
    """``(ord, category)`` from one row of sampled answers, defaults appended.

    The proposals come from a single request where the sample is under the token limit. A larger one
    is asked about in parts that are, and where these propose more than asked for, their
    themes are asked about once more. When no reply passes the proposals are the one category ``Error``;
    where only some parts fail, as an answer over the limit by itself does, it comes after the themes of the others.
    """
    spark = sample.sparkSession
    ledger_path = _ledger_path(spark, ledger_path, client_factory, "category-ledger")
    found = _themes(sample, client_factory, settings, ledger_path)
    error = F.when(F.col("failed"), F.array(F.lit(FAILED))).otherwise(F.array().cast("array<string>"))
    listed = F.concat("themes", error, F.array(*[F.lit(c) for c in DEFAULT_CATEGORIES]))
    return found.select(F.posexplode(listed).alias("ord", "category"))


def generate_categories(
    responses: DataFrame,
    client_factory: Callable[[], ModelClient],
    settings: CodingSettings = CodingSettings(),
    ledger_path: str | None = None,
) -> DataFrame:
    """Categories for a response table, from a sample of its distinct answers."""
    answers = distinct_responses(clean_responses(responses))
    sample = sample_array(answers, "response", settings.sample_size, settings.seed)
    return propose_categories(sample, client_factory, settings, ledger_path)


def code_batches(
    batches: DataFrame,
    categories: Sequence[str],
    client_factory: Callable[[], ModelClient],
    settings: CodingSettings,
    ledger_path: str | None = None,
) -> DataFrame:
    """``(batch_id, responses, codes, ..)``: each batch with its ledger row.

    The requests are written once: asking and pairing both start from that table.
    """
    spark = batches.sparkSession
    ledger_path = _ledger_path(spark, ledger_path, client_factory, "coding-ledger")
    requests = coding_requests(batches, categories, settings)
    reader = CodeReply(tuple(categories), settings.is_multicode, settings.strict_length)
    ledger = run_requests(requests, client_factory, reader, settings, ledger_path)
    return requests.select("request_key", "batch_id", "responses").join(ledger, "request_key")


def create_codeframe(
    responses: DataFrame,
    categories: Sequence[str],
    client_factory: Callable[[], ModelClient],
    settings: CodingSettings = CodingSettings(),
    ledger_path: str | None = None,
) -> DataFrame:
    """A codeframe for a response table: each distinct answer is asked about once.

    Give ``ledger_path`` a durable place to be able to restart without paying for
    the same prompts again.
    """
    answers = distinct_responses(clean_responses(responses), keep_empty=False)
    batches = make_batches(answers, settings.batch_size)
    allowed = promptable_categories(list(categories))
    coded = code_batches(batches, allowed, client_factory, settings, ledger_path)
    return build_codeframe(coded, settings.is_multicode, distinct=True)


def extend_codeframe(
    codeframe: DataFrame,
    responses: DataFrame,
    categories: Sequence[str],
    client_factory: Callable[[], ModelClient],
    settings: CodingSettings = CodingSettings(),
    ledger_path: str | None = None,
) -> DataFrame:
    """``codeframe`` grown by the answers of ``responses`` that it does not hold.

    Batches are cut from the order of the answers, so a codeframe that is built anew from a grown table
    has other batches, other prompts, and is paid for again. Here known answers are left out before
    the batches are cut, and only new ones are asked about. Entries that failed or have no code
    count as new. The codeframe must hold each answer once, as those that are read or built here do.
    """
    codes = F.col("categories") if settings.is_multicode else F.array("category")
    coded = codeframe.where(F.size(F.filter(codes, lambda c: c.isNotNull() & (c != FAILED))) == F.size(codes))
    if settings.is_multicode:
        coded = coded.where(F.col("categories").isNotNull())
    # Used to find what is new and in the result, and computed once.
    known = materialize(coded.select("response", "categories" if settings.is_multicode else "category"), "known", texts=True)
    answers = distinct_responses(clean_responses(responses), keep_empty=False)
    new = materialize(answers.join(known.select("response"), "response", "left_anti"), "new-answers", texts=True)
    batches = make_batches(new, settings.batch_size)
    allowed = promptable_categories(list(categories))
    asked = code_batches(batches, allowed, client_factory, settings, ledger_path)
    return known.unionByName(build_codeframe(asked, settings.is_multicode, distinct=True))


def categorize_responses(
    responses: DataFrame,
    codeframe: DataFrame,
    categories: Sequence[str],
    settings: CodingSettings = CodingSettings(),
) -> DataFrame:
    """The cleaned response table with its indicator columns."""
    return categorize(clean_responses(responses), codeframe, categories, settings.broadcast_bytes)


def categorized_output(
    spark: SparkSession,
    responses: DataFrame,
    categories_path: str,
    codeframe_path: str,
    settings: CodingSettings = CodingSettings(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From files: the indicator table, the answers that failed, and the codes not among the categories."""
    names = read_categories(spark, categories_path)
    read = read_codeframe_multi if settings.is_multicode else read_codeframe_single
    codeframe = materialize(read(spark, codeframe_path), "codeframe")
    coded = categorize_responses(responses, codeframe, names, settings)
    return coded, failed_answers(codeframe), unknown_codes(codeframe, names)
