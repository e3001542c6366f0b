import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.plans import executed_plan
from themeloom.operators import indicators
from themeloom.operators.audits import failed_answers, unknown_codes
from themeloom.operators.indicators import apply_codes, categorize, default_indicators, missing_to_null

def codeframe(spark, codes):
    return spark.createDataFrame(list(codes.items()), "response string, categories array<string>")


def single(spark, codes):
    return spark.createDataFrame(list(codes.items()), "response string, category string")


WIDE = ["Ring", "Red", "a.b `c`", "Uncategorized", "Error"]
CODES = {
    "one": ["Ring"],
    "two": ["Ring", "Red"],
    "helper last": ["Ring", "Uncategorized"],
    "helper first": ["Uncategorized", "Ring"],
    "helper only": ["Uncategorized"],
    "helper then unknown": ["Red", "Uncategorized", "Nothing"],
    "unknown": ["Nothing"],
    "failed": ["Error"],
    "none": [],
    "null list": None,
    "null code": [None, "Red"],
    "odd name": ["a.b `c`"],
    "twice": ["Red", "Red"],
    "": ["Red"],
}


def replayed(answer, names, codes=CODES):
    """Indicators of one answer, code by code."""
    if answer is None:
        return (None,) * len(names)
    values = {name: int(name == "Uncategorized") for name in names}
    for code in (codes.get(answer) or []) if answer else []:
        if code in values:
            values["Uncategorized"] = 0
            values[code] = 1
    return tuple(values[name] for name in names)


def table_of(spark, width, seed):
    """Rows of random answers, known, unknown and missing, under odd column names."""
    rng = random.Random(seed)
    columns = [f"q.{k} `x`" for k in range(width)]
    rows = [(str(i), *(rng.choice([*CODES, None, "never seen"]) for _ in columns)) for i in range(60)]
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in ["id", *columns])
    return spark.createDataFrame(rows, schema), rows, columns


def test_defaults_and_missing_answers(spark):
    df, rows, columns = table_of(spark, 3, 1)
    got = default_indicators(df, columns, WIDE)
    assert got.columns == df.columns + [f"{c}_{r}" for r in columns for c in WIDE]
    assert {kind for _, kind in got.dtypes[len(df.columns) :]} == {"bigint"}
    plain = replayed("never seen", WIDE)
    assert {tuple(r) for r in got.collect()} == {(*r, *plain * 3) for r in rows}
    middle = missing_to_null(got, columns[1], WIDE)
    want = {(*r, *plain, *(plain if r[2] is not None else (None,) * len(WIDE)), *plain) for r in rows}
    assert {tuple(r) for r in middle.collect()} == want


@pytest.mark.parametrize("room", [10**8, 0])
@pytest.mark.parametrize("form", ["multi", "single"])
def test_codes_set_on_one_column(spark, room, form):
    """Other columns keep their indicators, and so does this one where no code says otherwise."""
    df, rows, columns = table_of(spark, 2, 2)
    before = default_indicators(df, columns, WIDE).withColumn(f"Red_{columns[0]}", F.lit(1).cast("long"))
    frame = codeframe(spark, CODES)
    codes = CODES
    if form == "single":
        codes = {a: [c[0]] if c else [None] for a, c in CODES.items()}
        frame = single(spark, {a: c[0] for a, c in codes.items()})
    got = apply_codes(before, columns[0], frame, WIDE, broadcast_bytes=room)
    plain = replayed("never seen", WIDE)

    def own(answer):
        new = list(replayed(answer, WIDE, codes)) if answer is not None else list(plain)
        new[WIDE.index("Red")] = 1
        return tuple(new)

    assert got.columns == before.columns
    assert {tuple(r) for r in got.collect()} == {(*r, *own(r[1]), *plain) for r in rows}


@pytest.mark.parametrize("room", ["broadcast", "shuffle"])
@pytest.mark.parametrize("extra", [0, 150])
def test_all_rules_in_both_plans(spark, room, extra):
    names = WIDE[:2] + [f"More {i}" for i in range(extra)] + WIDE[2:]
    answers = [*CODES, None, "never seen"]
    rows = [(str(i), a, answers[-i]) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "id string, r1 string, `r.2` string")
    coded = categorize(df, codeframe(spark, CODES), names, broadcast_bytes=10**8 if room == "broadcast" else 0)
    assert coded.columns == df.columns + [f"{c}_{r}" for r in ("r1", "r.2") for c in names]
    got = {r[0]: tuple(r) for r in coded.collect()}
    assert got == {i: (i, a, b, *replayed(a, names), *replayed(b, names)) for i, a, b in rows}


def test_repeated_categories_share_a_column(spark):
    df = spark.createDataFrame([("1", "x")], "id string, r string")
    coded = categorize(df, single(spark, {"x": "A"}), ["A", "Uncategorized", "A"])
    assert coded.columns == ["id", "r", "A_r", "Uncategorized_r"]


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([("1", "x", 5)], "id string, r string, A_r int").select("id", "r")
    with pytest.raises(ValueError, match="share a name"):
        categorize(df, single(spark, {"x": "A"}), ["A", "a", "Uncategorized"])
    with pytest.raises(ValueError, match="Uncategorized"):
        categorize(df, single(spark, {"x": "A"}), ["A"])


def test_answer_with_two_entries_is_an_error(spark):
    df = spark.createDataFrame([("1", "x")], "id string, r string")
    twice = single(spark, {"x": "A"}).union(single(spark, {"x": "Uncategorized"}))
    with pytest.raises(PySparkException, match="coded more than once: x"):
        categorize(df, twice, ["A", "Uncategorized"])


def skewed(spark, tmp_path):
    """A third of all answers is one text, a third missing, and the rest differ."""
    path = str(tmp_path / "skewed")
    kind = F.col("id") % 3
    answer = F.when(kind == 0, F.lit("hot")).when(kind == 1, F.concat(F.lit("cold "), F.col("id") % 7000))
    spark.range(0, 60_000, 1, 8).select(F.col("id").cast("string"), answer.alias("r")).write.parquet(path)
    cold = spark.range(7000).select(F.concat(F.lit("cold "), F.col("id")).alias("response"), F.lit("A").alias("category"))
    hot = spark.createDataFrame([("hot", "B")], "response string, category string")
    return spark.read.parquet(path), cold.union(hot)


def test_small_codeframe_never_shuffles_the_responses(spark, tmp_path):
    df, codes = skewed(spark, tmp_path)
    plan = executed_plan(categorize(df, codes, ["A", "B", "Uncategorized"]))
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_large_codeframe_spreads_a_hot_answer(spark, tmp_path):
    """What is shuffled under any one key stays small although two keys hold most rows."""
    df, codes = skewed(spark, tmp_path)
    coded = categorize(df, codes, ["A", "B", "Uncategorized"], broadcast_bytes=0)
    plan = executed_plan(coded)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert "hashpartitioning(_place" in plan
    counts = {tuple(r)[:3]: r[3] for r in coded.groupBy("A_r", "B_r", "Uncategorized_r").count().collect()}
    assert counts == {(0, 1, 0): 20_000, (1, 0, 0): 20_000, (None, None, None): 20_000}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = indicators._shuffled_lookup(
        df, "r", indicators._written_masks(codes, ["A", "B", "Uncategorized"]), "c", hot(spark, df), 8, ["id"]
    )
    sizes = [r[1] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2 * 60_000 / 8


def test_the_shuffles_of_a_large_codeframe_do_not_grow_with_the_response_columns(spark):
    """Only digests meet the masks, and a row is moved once."""
    counts = []
    for width in (2, 5):
        df, rows, columns = table_of(spark, width, seed=width)
        coded = categorize(df, codeframe(spark, CODES), WIDE, broadcast_bytes=0)
        counts.append(executed_plan(coded).count("Exchange "))
        want = {r[0]: tuple(r) + tuple(v for a in r[1:] for v in replayed(a, WIDE)) for r in rows}
        assert {r[0]: tuple(r) for r in coded.collect()} == want
    assert counts[0] == counts[1] <= 4


def test_a_hot_answer_in_many_columns_is_spread(spark, tmp_path):
    df, codes = skewed(spark, tmp_path)
    df = df.select("id", "r", F.col("r").alias("q"), F.lit("hot").alias("p"))
    coded = categorize(df, codes, ["A", "B", "Uncategorized"], broadcast_bytes=0)
    counts = {tuple(r)[:3]: r[3] for r in coded.groupBy("B_r", "A_q", "B_p").count().collect()}
    assert counts == {(1, 0, 1): 20_000, (0, 1, 1): 20_000, (None, None, 1): 20_000}


def test_rows_of_frequent_answers_only_stay(spark, tmp_path, monkeypatch):
    df, codes = skewed(spark, tmp_path)
    df = df.select("id", "r", F.lit("hot").alias("p"))
    looked_up, results = [], []
    lookup = indicators._shuffled_lookup
    monkeypatch.setattr(indicators, "_shuffled_lookup", lambda df, *rest: looked_up.append(df.count()) or lookup(df, *rest))
    for most in (256, 0):
        monkeypatch.setattr(indicators, "MOST_NEAR", most, raising=False)
        results.append(sorted(categorize(df, codes, ["A", "B", "Uncategorized"], broadcast_bytes=0).collect(), key=lambda r: r.id))
    assert results[0] == results[1]
    assert looked_up == [20_000, 100_000]


def test_the_plan_of_masks_is_the_same_for_thousands_of_categories(spark):
    codes = codeframe(spark, {"a": ["C7", "C1999", "Nope"], "b": ["Uncategorized", "C0"], "c": ["C0", "Uncategorized", "Nope"]})
    plans = []
    for n in (3, 2000):
        names = [f"C{k}" for k in range(n)] + ["Uncategorized"]
        masks = indicators.code_masks(codes, names)
        plans.append(masks._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        found = {
            r.response: {62 * w + b for w, word in enumerate(r.mask) for b in range(62) if word >> b & 1} for r in masks.collect()
        }
        want = {"a": {7, 1999}, "b": {0}, "c": {0, n}}
        assert found == {k: {p for p in v if p <= n} for k, v in want.items() if k != "a" or n > 3}
    assert plans[0] == plans[1]


def hot(spark, df):
    return indicators.hot_digests(df, 8)


def test_hot_answers_are_counted_over_all_rows(spark, tmp_path):
    df, _ = skewed(spark, tmp_path)
    (digest,) = hot(spark, df)
    assert digest == spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert indicators.hot_digests(df.where("false"), 8) == []
    every = spark.range(40).select("id", (F.col("id") % 4).cast("string").alias("r"))
    assert len(indicators.hot_digests(every, 8)) == 4


def test_stream_with_a_large_codeframe(spark, tmp_path):
    from themeloom.config import CodingSettings
    from themeloom.streaming.coding import categorize_stream

    df, codes = skewed(spark, tmp_path)
    frame = codes.select("response", F.array("category").alias("categories"))
    arriving = spark.readStream.schema(df.schema).parquet(str(tmp_path / "skewed"))
    query = categorize_stream(
        arriving, frame, ["A", "B", "Uncategorized"], str(tmp_path / "out"), str(tmp_path / "state"),
        CodingSettings(broadcast_bytes=0), availableNow=True,
    )
    query.awaitTermination()
    counts = spark.read.parquet(str(tmp_path / "out")).groupBy("A_r", "B_r", "Uncategorized_r").count()
    assert {tuple(r)[:3]: r[3] for r in counts.collect()} == {
        (0, 1, 0): 20_000, (1, 0, 0): 20_000, (None, None, None): 20_000,
    }


def test_audits(spark):
    multi = codeframe(spark, {"a": ["Error"], "b": ["Red", "Nope"], "c": ["Red"], "d": []})
    assert [r.response for r in failed_answers(multi).collect()] == ["a"]
    assert {tuple(r) for r in unknown_codes(multi, ["Red", "Error"]).collect()} == {("b", "Nope")}
    gaps = codeframe(spark, {"a": ["Red", None], "b": None})
    assert {tuple(r) for r in unknown_codes(gaps, ["Red"]).collect()} == {("a", None)}
    assert {tuple(r) for r in unknown_codes(single(spark, {"a": None}), ["Red"]).collect()} == {("a", None)}
    one = single(spark, {"a": "Error", "b": "Nope", "c": "Red"})
    assert [r.response for r in failed_answers(one).collect()] == ["a"]
    assert {tuple(r) for r in unknown_codes(one, ["Red"]).collect()} == {("a", "Error"), ("b", "Nope")}
