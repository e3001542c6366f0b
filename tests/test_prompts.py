from pyspark.sql import functions as F

from themeloom.functions.prompts import category_prompt, coding_prompt, estimate_tokens, token_counter


def one(spark, value, build):
    df = spark.createDataFrame([(value,)], "v array<string>")
    return df.select(build(F.col("v"))).first()[0]


def test_category_prompt(spark):
    got = one(spark, ["a", "b c"], lambda v: category_prompt(v, "Why {this}?", 5))
    lines = got.split("\n")
    assert lines[0] == "List the 5 most relevant thematic categories for this sample of survey responses."
    assert lines[1].endswith('in the format: `["name1", "name2", ...]`')
    assert lines[2:] == [
        "    ", "    Question:", "    `Why {this}?`", "    ", "    Responses:", "    ```",
        "    ['a', 'b c']", "    ```",
    ]
    assert "    []\n" in one(spark, [], lambda v: category_prompt(v, "q", 5))


def test_coding_prompt(spark):
    single = one(spark, ["yes", "no way"], lambda v: coding_prompt(v, "Why?", ["A", "B C"], False))
    assert single.split("\n")[3:] == [
        "    Question:", "    `Why?`", "    ", "    Responses:", "    `1: yes", "2: no way`", "    ",
        "    categories:", "    ```", "    A", "B C", "    ```",
    ]
    assert "using one of the provided categories." in single
    assert "each element is a category name for each response" in single
    multi = one(spark, ["yes"], lambda v: coding_prompt(v, "Why?", ["A"], True))
    assert "using one or multiple of the provided categories." in multi
    assert "each element is a list of category names for each response" in multi


def test_token_estimates(spark):
    df = spark.createDataFrame([("12345678",), ("123456789",)], "p string")
    assert [r[0] for r in df.select(estimate_tokens(F.col("p"))).collect()] == [12, 13]
    counter = token_counter(lambda: lambda text: text.split("5"))
    assert [r[0] for r in df.select(counter("p")).collect()] == [12, 12]
