"""A finished codeframe applied to answers as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from themeloom.config import CodingSettings
from themeloom.plans.jobs import categorize_responses


def categorize_stream(
    arriving: DataFrame,
    codeframe: DataFrame,
    categories: Sequence[str],
    output_path: str,
    checkpoint_path: str,
    settings: CodingSettings = CodingSettings(),
    **trigger: object,
) -> StreamingQuery:
    """Append coded answers to a Parquet table.

    Cleaning and lookup keep no state: every row is coded on its own against the
    static codeframe, so there is no watermark and nothing grows over time.
    """
    coded = categorize_responses(arriving, codeframe, categories, settings)
    writer = coded.writeStream.format("parquet").option("checkpointLocation", checkpoint_path)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start(output_path)
