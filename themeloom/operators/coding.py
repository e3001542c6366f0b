"""From batches and checked replies to a codeframe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_codeframe(coded: DataFrame, is_multicode: bool, distinct: bool = False) -> DataFrame:
    """``(response, category)`` or ``(response, categories)``, one row per answer.

    ``coded`` holds ``batch_id``, ``responses`` and ``codes`` (one list of codes
    per answer). Answers and codes pair by position up to the shorter of the two;
    when an answer occurs more than once its last batch decides; the empty answer
    is left out. ``distinct`` says that no answer occurs twice, which saves bringing
    equal ones together.
    """
    paired = F.least(F.size("responses"), F.size("codes"))
    pairs = F.arrays_zip(
        F.slice("responses", 1, paired).alias("response"), F.slice("codes", 1, paired).alias("categories")
    )
    placed = coded.where(paired > 0).select(F.col("batch_id"), F.posexplode(pairs).alias("_pos", "_pair"))
    placed = placed.select("batch_id", "_pos", "_pair.response", "_pair.categories")
    codeframe = placed.where(F.col("response") != "").select("batch_id", "_pos", "response", "categories")
    if not distinct:
        last = F.max_by("categories", F.struct("batch_id", "_pos", "categories"))
        codeframe = codeframe.groupBy("response").agg(last.alias("categories"))
    codeframe = codeframe.select("response", "categories")
    if is_multicode:
        return codeframe
    return codeframe.select("response", F.try_element_at("categories", F.lit(1)).alias("category"))


def coding_report(coded: DataFrame) -> DataFrame:
    """One row on batches with their ledger rows: how many answers fared how.

    ``unpaired`` answers have no code because their reply was too short,
    ``over_limit`` ones are too long to be asked about, ``failed`` ones got no good reply.
    """
    answers = F.size("responses")
    failed = F.col("status") == "error"
    too_long = failed & F.coalesce(F.col("last_error") == "over_token_limit", F.lit(False))

    def total(count, where):
        return F.coalesce(F.sum(F.when(where, count)), F.lit(0)).cast("long")

    paired = F.least(answers, F.size("codes"))
    return coded.agg(
        total(answers, F.lit(True)).alias("answers"),
        total(paired, ~failed).alias("coded"),
        total(answers - paired, ~failed).alias("unpaired"),
        total(answers, too_long).alias("over_limit"),
        total(answers, failed & ~too_long).alias("failed"),
    )
