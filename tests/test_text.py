import random
import re

import pandas as pd
from pyspark.sql import functions as F

from themeloom.functions.text import clean_text, redact_text, trim_whitespace


def cleaned(spark, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [row[0] for row in df.select(clean_text(F.col("v"))).collect()]


def by_rule(text):
    """Lower case, white space to one space, then only letters, digits and spaces, trimmed."""
    letters = set("abcdefghijklmnopqrstuvwxyz0123456789 ")
    return "".join(c for c in re.sub(r"\s+", " ", text.lower()) if c in letters).strip()


def test_clean_text_agrees_on_random_texts(spark):
    rng = random.Random(3)
    pieces = ["Aa", "zZ9", "É", "ß", "İ", "K", "_", ".", "&", "☃", "😀", "\u200b", " ", "\t", "\n", "\xa0", "\u2003",
              "\x85", "\x1c", "\u2028", "0"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(3000)]
    assert cleaned(spark, [*texts, None]) == [*map(by_rule, texts), None]


def test_numbers_become_text(spark):
    assert cleaned(spark, [1, None], "long") == ["1", None]
    assert cleaned(spark, [True], "boolean") == ["true"]


def test_clean_text_agrees_on_code_points(spark):
    points = [i for i in range(1, 0x30000) if not 0xD800 <= i <= 0xDFFF]  # further planes hold no letters
    texts = [f"a {chr(i)} b{chr(i)}{chr(i)}C{chr(i)}" for i in points]
    df = spark.createDataFrame(pd.DataFrame({"i": points, "t": texts}))
    got = df.select("i", clean_text(F.col("t")).alias("t")).toPandas().sort_values("i").t.tolist()
    for text, found in zip(texts, got):
        assert found == by_rule(text), text


def test_trim_whitespace(spark):
    df = spark.createDataFrame([(" \n x y  \n",)], "v string")
    assert df.select(trim_whitespace(F.col("v"))).first()[0] == "x y"


def test_redaction_is_ordered_literal_and_spans_lines(spark):
    df = spark.createDataFrame([("a1b\nc a2b",)], "v string")
    rules = [(r"a.b\nc", r"$1\2"), (r"\d", "#")]
    assert df.select(redact_text(F.col("v"), rules)).first()[0] == r"$#\# a#b"

