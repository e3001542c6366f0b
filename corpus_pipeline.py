"""Documents judged, deduplicated, mixed and packed, each stage by one operator of ``themeloom.llm``.

Every stage takes the documents its predecessor kept and returns documents again
(the last one returns packed pieces). The columns of the documents are kept as
they are; only the removal of repeated passages rewrites ``text`` and ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from themeloom.llm.minhash import first_documents
from themeloom.llm.mixing import mixed_documents
from themeloom.llm.packing import pack_documents
from themeloom.llm.quality import kept_documents
from themeloom.llm.suffix import documents_without_repeats
from themeloom.tables import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id; rows without id stay."""
    return first_documents(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes and more that an earlier document has; emptied ones stay, empty."""
    return documents_without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the targets of source, language and topic, as often as holds them; rows of rare cells repeat."""
    return mixed_documents(docs, repeats=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, one row per piece with its ids."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

# Trained models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
