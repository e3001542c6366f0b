"""The operators of this folder as queries on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.best_fit import pack_matrix
from themeloom.llm.conversations import repair_damaged
from themeloom.llm.language import identify_languages
from themeloom.llm.main_text import extract_main_text
from themeloom.llm.minhash import near_duplicates
from themeloom.llm.mixing import draw_documents
from themeloom.llm.packing import pack_documents
from themeloom.llm.private_data import KINDS, find_private_data
from themeloom.llm.quality import judge_quality
from themeloom.llm.resampling import resample
from themeloom.llm.suffix import remove_repeats
from themeloom.llm.topk import top_k
from themeloom.llm.url_rules import RULE_SCHEMA, RULES, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_pack_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_matrix(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=80, words=2)


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_documents(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5, scale=256.0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = identify_languages(documents, documents.where(~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, RULE_SCHEMA))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private_data(table(spark, sf_dir, "documents"))
    counts = [f"n_{kind}" for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_pack_min_slack": op1_pack_min_slack,
    "op2_pack_matrix": op2_pack_matrix,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_remove_repeats": op4_remove_repeats,
    "op5_mix_sources": op5_mix_sources,
    "op6_top_k": op6_top_k,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_main_text": op9_main_text,
    "op10_url_rules": op10_url_rules,
    "op11_private_data": op11_private_data,
    "op12_target_resampling": op12_target_resampling,
    "op13_conversation_repair": op13_conversation_repair,
}
