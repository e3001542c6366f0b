from themeloom.plans.jobs import categorize_responses
from themeloom.streaming.coding import categorize_stream

NAMES = ["Red", "Blue", "Uncategorized"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    schema = "id string, r1 string, r2 string"
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("1", "Red!", None), ("2", " blue", "red"), ("3", "!!!", "green")]
    codes = spark.createDataFrame([("red", ["Red"]), ("blue", ["Blue", "Red"])], "response string, categories array<string>")
    spark.createDataFrame(rows[:2], schema).write.parquet(incoming)

    def run():
        arriving = spark.readStream.schema(schema).parquet(incoming)
        query = categorize_stream(arriving, codes, NAMES, out, str(tmp_path / "state"), availableNow=True)
        query.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()), key=str)

    def batch(count):
        df = spark.createDataFrame(rows[:count], schema)
        return sorted(map(tuple, categorize_responses(df, codes, NAMES).collect()), key=str)

    assert run() == batch(2)
    spark.createDataFrame(rows[2:], schema).write.mode("append").parquet(incoming)
    assert run() == batch(3)  # only the new file is read; earlier rows stay
