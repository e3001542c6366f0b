"""What a Python worker keeps from task to task."""

from themeloom.llm import arrow


def test_tables_of_other_operators_go():
    made = []

    def make(name):
        return lambda: made.append(name) or name

    arrow._let_go(())
    assert [arrow.held("a", make("a")), arrow.held("a", make("a"))] == ["a", "a"] and made == ["a"]
    arrow._let_go(("a",))
    assert arrow.held("a", make("again")) == "a"
    arrow._let_go(("b",))
    assert arrow.held("a", make("anew")) == "anew"
    arrow._let_go(())


def test_let_go_within_a_session(spark):
    rows = spark.range(40).selectExpr("cast(id as string) AS text").repartition(2)

    def keeping(batches):
        for batch in batches:
            arrow.held("words", dict)
            yield batch

    def seen(batches):
        for batch in batches:
            assert "words" not in arrow._HELD
            yield batch

    assert arrow.map_texts(rows, keeping, rows.schema, keeps=("words",)).count() == 40
    assert arrow.map_texts(rows, seen, rows.schema).count() == 40
