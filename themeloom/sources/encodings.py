"""Which encoding each text file uses, decided by Spark over whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the encodings told apart.
UTF_8 = "utf-8"
UTF_16 = "utf-16"
WESTERN = "windows-1252"
UTF_16_MARKS = (b"\xff\xfe", b"\xfe\xff")

# The bytes where windows-1252 differs from iso-8859-1, which Spark can read.
_C1_BYTES = range(0x80, 0xA0)
_C1_LATIN = "".join(chr(b) for b in _C1_BYTES)
_C1_WESTERN = "".join(bytes([b]).decode(WESTERN, errors="replace") for b in _C1_BYTES)


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``(path, encoding, header)`` per file; the header is the file's first line as bytes.

    The text source hands over the raw bytes of each line and splits large files,
    so every byte is checked, in parallel, and only three flags per file and task
    are shuffled. A byte-order mark that starts a line means UTF-16 (such bytes
    are never valid UTF-8); otherwise a file is UTF-8 when all its lines are, else
    8-bit Western.
    """
    raw = F.col("value").cast("binary")
    marked = F.lit(False)
    for mark in UTF_16_MARKS:
        marked = marked | F.startswith(raw, F.lit(mark))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        marked.alias("marked"),
        F.contains(raw, F.lit(b"\x00")).alias("zeros"),
        F.is_valid_utf8("value").alias("valid"),
        # The first line of the file's first block, in the order its one task reads it.
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("place"),
        raw.alias("line"),
    )
    files = lines.groupBy("path").agg(
        F.bool_or("marked").alias("marked"), F.bool_or("zeros").alias("zeros"), F.bool_and("valid").alias("valid"),
        F.min_by("line", "place").alias("header"),
    )
    encoding = (
        F.when(F.col("marked") & F.col("zeros"), UTF_16).when(F.col("valid"), UTF_8).otherwise(WESTERN)
    )
    return files.select("path", encoding.alias("encoding"), "header")


def spark_charset(encoding: str) -> str:
    """The charset name Spark's readers take for a detected encoding."""
    return "iso-8859-1" if encoding == WESTERN else encoding


def repaired(text: Column, encoding: str) -> Column:
    """``text`` read under ``spark_charset``, as the detected encoding means it."""
    return F.translate(text, _C1_LATIN, _C1_WESTERN) if encoding == WESTERN else text
