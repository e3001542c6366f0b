"""Reading executed plans in tests."""


def executed_plan(df) -> str:
    """The final adaptive plan, after running it."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]
