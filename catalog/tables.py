"""Survey-like tables derived from the supplied ones, in SQL both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Long answers in four languages; the second column has missing answers and ones
# that clean to nothing.
NOTES = """
SELECT CAST(doc_id AS STRING) AS id, text AS r1,
       CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN '???'
                 ELSE concat('  ', upper(source), '! ') END AS r2
FROM {documents}"""

# Short answers that repeat a lot.
PARTS = """
SELECT CAST(p_partkey AS STRING) AS id,
       CASE WHEN p_size <= 5 THEN NULL WHEN p_size <= 8 THEN '!!!'
            WHEN p_size <= 20 THEN concat('  ', upper(p_name), '! ') ELSE p_name END AS r1,
       CASE WHEN p_size > 45 THEN NULL ELSE p_type END AS r2
FROM {part}"""

# Two columns of very few distinct answers, each a large share of all rows.
LINES = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-',
              CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id,
       l_returnflag AS r1, l_linestatus AS r2
FROM {lineitem}"""

# Cells that stand for a missing answer, and one that does not for its blanks.
CELLS = """
SELECT CAST(doc_id AS STRING) AS id, text AS r1,
       CASE lang WHEN 'de' THEN 'N/A' WHEN 'fr' THEN 'null' WHEN 'es' THEN ' NA ' ELSE source END AS r2
FROM {documents}"""

# Codes of short answers, joined by a bar: known, unknown, failed and none.
PART_CODES = """
SELECT response,
       CASE WHEN response LIKE '%bolt%' THEN 'Error'
            WHEN response LIKE '%rod%' THEN ''
            WHEN response LIKE '%anvil%' THEN 'Unknown|Red|Uncategorized|Unknown'
            WHEN response LIKE '%gizmo%' THEN 'Uncategorized|Gear|Red'
            WHEN response LIKE '%hot%' THEN 'Ring|Uncategorized'
            WHEN response LIKE '%ring%' THEN 'Ring|Red'
            WHEN response LIKE '%widget%' THEN 'Widget'
            WHEN response LIKE '%standard%' THEN 'Unknown'
            ELSE 'Other' END AS codes
FROM {answers}"""

# Model replies about short answers, good and bad in the ways replies are.
REPLIES = """
SELECT p_partkey AS id, p_type AS kind, w1, w2,
       CASE p_type WHEN 'STANDARD' THEN concat(' ```json\n["', w2, '",\n"', w1, '"]\n``` ')
                   WHEN 'ECONOMY' THEN concat('["', w2, '", ', CAST(p_size AS STRING), ']')
                   WHEN 'PROMO' THEN concat('{{"code": "', w2, '"}}')
                   WHEN 'SMALL' THEN concat('["', w2, '"] as asked')
                   WHEN 'LARGE' THEN concat('[["', w2, '", "', w1, '"], ["Red"]]')
                   ELSE concat('[["', w2, '"], "', w1, '"]') END AS reply
FROM (SELECT p_partkey, p_type, p_size,
             concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2)) AS w1,
             concat(upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) AS w2
      FROM {part}) AS words"""

NOTE_CATEGORIES = ["Thing", "Ering", "Nicht", "Cinque", "Src1", "Other", "Bad response", "Uncategorized"]
PART_CATEGORIES = ["Ring", "Plate", "Widget", "Gear", "Red", "Other", "Bad response", "Uncategorized"]
QUESTION = "What did you notice?"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, NOTES, "documents")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PARTS, "part")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, LINES, "lineitem")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, REPLIES, "part")


def part_codeframe(answers: DataFrame, is_multicode: bool) -> DataFrame:
    """The codes above as a codeframe; the single form takes the first code."""
    coded = answers.sparkSession.sql(PART_CODES, answers=answers)
    codes = F.filter(F.split("codes", r"\|"), lambda c: c != "")
    if is_multicode:
        return coded.select("response", codes.alias("categories"))
    return coded.select("response", F.try_element_at(codes, F.lit(1)).alias("category"))
