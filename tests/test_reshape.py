import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.plans import executed_plan
from themeloom.operators.batching import make_batches, with_position
from themeloom.operators.reshape import (
    clean_responses,
    distinct_responses,
    promptable_categories,
    split_columns,
    unpivot_responses,
)
from themeloom.operators.sampling import sample_n


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture
def responses(spark):
    rows = [("1", "Yes!", "no"), ("2", None, "yes"), ("3", "!!!", None), ("4", "No", "maybe  so")]
    return spark.createDataFrame(rows, "uuid string, `first.answer` string, second string")


def test_split_is_by_position(responses):
    assert split_columns(responses) == ("uuid", ["first.answer", "second"])


def test_clean_keeps_id_and_order(responses):
    rows = [tuple(r) for r in clean_responses(responses).orderBy("uuid").collect()]
    assert rows == [("1", "yes", "no"), ("2", None, "yes"), ("3", "", None), ("4", "no", "maybe so")]


def test_numbers_are_answers_unless_not_a_number(spark):
    df = spark.createDataFrame([("1", float("nan"), 7), ("2", 2.5, None)], "id string, a double, b long")
    assert [tuple(r) for r in clean_responses(df).orderBy("id").collect()] == [("1", None, "7"), ("2", "25", None)]


def test_unpivot_drops_missing_only(responses):
    long = unpivot_responses(clean_responses(responses)).collect()
    assert len(long) == 6
    assert ("3", "first.answer", "") in [tuple(r) for r in long]


def test_distinct_over_all_columns(responses):
    cleaned = clean_responses(responses)
    everything = {r.response for r in distinct_responses(cleaned).collect()}
    assert everything == {"yes", "no", "", "maybe so"}
    assert {r.response for r in distinct_responses(cleaned, keep_empty=False).collect()} == everything - {""}


def test_distinct_combines_before_the_shuffle(responses):
    plan = executed_plan(distinct_responses(clean_responses(responses)))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_promptable_categories():
    assert promptable_categories(["A", "Uncategorized", "B"]) == ["A", "B"]
    with pytest.raises(ValueError):
        promptable_categories(["A", "B"])


def letters(spark, values="abcdef"):
    return spark.createDataFrame([(v,) for v in values], "response string")


def test_sample_has_the_asked_size(spark):
    rows = [r.response for r in sample_n(letters(spark), "response", 3, "1").collect()]
    assert len(rows) == len(set(rows)) == 3 and set(rows) <= set("abcdef")
    again = [r.response for r in sample_n(letters(spark).repartition(5), "response", 3, "1").collect()]
    assert again == rows
    other = [sample_n(letters(spark), "response", 3, str(seed)).collect() for seed in range(5)]
    assert len({str(o) for o in other}) > 1


@pytest.mark.parametrize("values", ["abcdef", ""])
def test_sample_larger_than_the_input_is_an_error(spark, values):
    with pytest.raises(PySparkException, match="cannot sample 100"):
        sample_n(letters(spark, values), "response", 100, "1").collect()


def test_sample_sorts_no_more_than_it_keeps(spark):
    plan = executed_plan(sample_n(letters(spark), "response", 3, "1"))
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize(
    "size, lengths", [(2, [2, 2, 2]), (4, [4, 2]), (6, [6]), (100, [6]), (1, [1] * 6)]
)
def test_batches_are_consecutive(spark, size, lengths):
    batches = make_batches(letters(spark), size).orderBy("batch_id").collect()
    assert [len(b.responses) for b in batches] == lengths
    assert [b.batch_id for b in batches] == list(range(len(lengths)))
    assert [r for b in batches for r in b.responses] == sorted("abcdef", key=lambda r: (digest(r), r))


def test_no_answers_give_no_batches(spark):
    assert make_batches(letters(spark, ""), 3).count() == 0


def test_repeats_are_batched_once(spark):
    batches = make_batches(letters(spark, "aaaaaaaabbbbc"), 2).collect()
    assert sorted(r for b in batches for r in b.responses) == ["a", "b", "c"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.sets(st.text(max_size=6), max_size=40))
def test_positions_equal_one_global_ranking(spark, values):
    values = {v.replace("\x00", "") for v in values if v.isprintable()}
    df = spark.createDataFrame([(v,) for v in values], "response string")
    got = {r.response: r.position for r in with_position(df, "response").collect()}
    ranked = sorted(values, key=lambda r: (digest(r), r.encode()))
    assert got == {r: i for i, r in enumerate(ranked)}


def test_batching_scans_its_input_once(spark, tmp_path):
    """Both passes start from one distinct; digests are taken after it."""
    path = str(tmp_path / "answers")
    spark.range(1000).select((F.col("id") % 300).cast("string").alias("response")).write.parquet(path)
    plan = executed_plan(make_batches(spark.read.parquet(path).distinct(), 3))
    assert "ReusedExchange" in plan
    below = plan[plan.rindex("HashAggregate(keys=[response") :]
    assert "md5" not in below
