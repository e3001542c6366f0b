import functools
import random
import time
from collections import namedtuple
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from themeloom.clients import ChatClient, FirstWordClient, KeywordClient, RateLimited, ScriptedClient
from themeloom.config import CodingSettings
from themeloom.functions.prompts import coding_prompt, token_counter
from themeloom.operators import inference
from themeloom.operators.coding import build_codeframe, coding_report
from themeloom.operators.inference import CodeReply, Pace, coding_requests, read_ledger, run_requests, with_request
from themeloom.plans.jobs import (
    code_batches,
    create_codeframe,
    extend_codeframe,
    generate_categories,
    propose_categories,
)
from themeloom.tables import scratch_path

FAST = CodingSettings(question="Why?", paced=False, backoff_seconds=0.0, concurrency=2, calls_per_task=1)
CATEGORIES = ["Red", "Blue", "Other"]


def batches(spark, *groups):
    return spark.createDataFrame(list(enumerate(groups)), "batch_id long, responses array<string>")


def ask(spark, replies, settings=FAST, answers=("a red one", "blue")):
    coded = code_batches(batches(spark, list(answers)), CATEGORIES, lambda: ScriptedClient(replies), settings)
    return coded.first()


def test_good_reply_at_once(spark):
    row = ask(spark, ['["Red", "Blue"]'])
    assert (row.attempts, row.status, row.last_error, row.codes) == (1, "ok", None, [["Red"], ["Blue"]])


def test_factories_may_be_partial(spark):
    client = functools.partial(ScriptedClient, ['["Red", "Blue"]'])
    assert code_batches(batches(spark, ["red", "blue"]), CATEGORIES, client, FAST).first().status == "ok"


def test_every_kind_of_failure_is_tried_again(spark):
    replies = ["sorry", '["Green"]', '{"a": 1}', "", RuntimeError("busy"), '["Red", "Blue"]']
    row = ask(spark, replies)
    assert (row.attempts, row.status, row.last_error) == (6, "ok", "busy")


def test_being_slowed_down_is_no_attempt(spark):
    row = ask(spark, [RateLimited("429")] * 90 + ['["Red", "Blue"]'])
    assert (row.attempts, row.status, row.last_error) == (1, "ok", None)


def test_after_the_last_attempt_all_answers_are_failed(spark):
    row = ask(spark, ["sorry"])
    assert (row.attempts, row.status, row.last_error) == (6, "error", "not_json")
    assert row.codes == [["Error"], ["Error"]]
    single = build_codeframe(spark.createDataFrame([row]), False).collect()
    assert {(r.response, r.category) for r in single} == {("a red one", "Error"), ("blue", "Error")}
    multi = build_codeframe(spark.createDataFrame([row]), True).collect()
    assert all(r.categories == ["Error"] for r in multi)


def test_lengths_are_free_unless_strict(spark):
    assert ask(spark, ['["Red"]']).status == "ok"
    strict = CodingSettings(paced=False, backoff_seconds=0.0, strict_length=True, max_attempts=2)
    assert ask(spark, ['["Red"]'], strict).last_error == "wrong_length"


def test_request_over_the_limit_is_not_sent(spark):
    small = replace(FAST, tokens_per_minute=20)
    row = ask(spark, [RuntimeError("must not be asked")], small, answers=["a red one"])
    assert (row.attempts, row.status, row.last_error) == (0, "error", "over_token_limit")


def test_a_long_answer_costs_its_neighbours_nothing(spark):
    """A batch over the limit is asked answer by answer."""
    settings = replace(FAST, tokens_per_minute=300)
    many = batches(spark, ["apple red", "x" * 2000, "blue"], ["red"])
    coded = code_batches(many, CATEGORIES, lambda: KeywordClient(False), settings)
    found = {r.responses[0]: (r.status, r.codes) for r in coded.collect()}
    assert found == {
        "apple red": ("ok", [["Red"]]), "x" * 2000: ("error", [["Error"]]), "blue": ("ok", [["Blue"]]),
        "red": ("ok", [["Red"]]),
    }
    report = coding_report(coded).first()
    assert (report.answers, report.coded, report.unpaired, report.over_limit, report.failed) == (4, 3, 0, 1, 0)


def test_report_counts_answers_lost_to_short_replies(spark):
    coded = code_batches(batches(spark, ["red", "blue"]), CATEGORIES, lambda: ScriptedClient(['["Red"]']), FAST)
    report = coding_report(coded).first()
    assert (report.answers, report.coded, report.unpaired, report.over_limit, report.failed) == (2, 1, 1, 0, 0)


def test_another_model_or_reading_asks_again(spark, tmp_path):
    ledger = str(tmp_path / "ledger")

    def asked(settings, reply):
        coded = code_batches(batches(spark, ["red", "blue"]), CATEGORIES, lambda: ScriptedClient([reply]), settings, ledger)
        row = coded.first()
        return row.status, row.codes

    assert asked(FAST, '["Red"]') == ("ok", [["Red"]])
    assert asked(FAST, '["Blue", "Blue"]') == ("ok", [["Red"]])  # from the ledger
    strict = replace(FAST, strict_length=True)
    assert asked(strict, '["Blue", "Blue"]') == ("ok", [["Blue"], ["Blue"]])
    assert asked(replace(FAST, model="other"), '["Other", "Red"]') == ("ok", [["Other"], ["Red"]])


def test_a_hosted_model_needs_a_ledger_of_its_own(spark):
    with pytest.raises(ValueError, match="ledger path"):
        code_batches(batches(spark, ["red"]), CATEGORIES, functools.partial(ChatClient, "m"), FAST)


@pytest.mark.parametrize("n", [12, 120])
def test_jobs_and_files_do_not_grow_with_the_requests(spark, tmp_path, n):
    ledger = tmp_path / "ledger"
    settings = replace(FAST, requests_per_task=1, most_waves=4)
    many = batches(spark, *[[f"red {i}"] for i in range(n)])
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    coded = code_batches(many, CATEGORIES, lambda: KeywordClient(False), settings, str(ledger))
    assert coded.count() == n
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before
    assert jobs <= 40
    parts = [p for p in ledger.glob("part-*") if not p.name.startswith(".")]
    assert len(parts) <= 4 * settings.tasks + 8
    assert not [p for p in ledger.iterdir() if p.is_dir()]


def test_calls_in_flight_share_a_task(spark):
    class Slow(KeywordClient):
        def complete(self, prompt):
            time.sleep(0.5)
            return super().complete(prompt)

    settings = replace(FAST, concurrency=8, calls_per_task=8)
    assert settings.tasks == 1
    many = batches(spark, *[[f"red {i}"] for i in range(16)])
    start = time.time()
    assert code_batches(many, CATEGORIES, lambda: Slow(False), settings).where("status = 'ok'").count() == 16
    one_by_one = 16 * 0.5
    assert time.time() - start < one_by_one


@pytest.mark.parametrize("seed", range(4))
def test_attempts_keep_both_limits(seed):
    """Tasks that fail, are slowed down or run again never take more than the limits give."""
    rng = random.Random(seed)
    settings = CodingSettings(tokens_per_minute=6_000, requests_per_minute=60, concurrency=3, calls_per_task=1)
    Request = namedtuple("Request", "cost admit_us")
    costs = [rng.randint(20, 400) for _ in range(240)]
    line, requests = 0.0, []
    for cost in costs:  # as the plan admits them
        line += 60 * max(cost / 6_000, 1 / 60)
        requests.append(Request(cost, int(max(0.0, line - 60) * 1e6)))
    sent = []
    for task in range(settings.tasks):
        own = requests[task :: settings.tasks]
        pace, now = Pace(settings, 0.0, again=False), 0.0
        for k, request in enumerate(own):
            if task == 1 and k == 40:  # lost: all is asked again
                pace = Pace(settings, 0.0, again=True)
                for repeated in own[:40]:
                    now = pace.send_time(repeated, True, now)
                    sent.append((now, repeated.cost))
            for attempt in range(rng.choice([1, 1, 1, 2, 4])):
                now = pace.send_time(request, attempt == 0, now)
                sent.append((now, request.cost))
    left, last = {"tokens": 6_000.0, "requests": 60.0}, 0.0
    for at, cost in sorted(sent):
        for name, limit, used in (("tokens", 6_000, cost), ("requests", 60, 1)):
            left[name] = min(limit, left[name] + (at - last) * limit / 60) - used
            assert left[name] >= -1e-3, (name, at)
        last = at


def test_a_given_tokenizer_plans_the_requests(spark):
    count = token_counter(lambda: str.split)
    settings = replace(FAST, token_counter=count, expected_reply_tokens=5)
    row = coding_requests(batches(spark, ["red", "blue"]), CATEGORIES, settings).first()
    assert row.cost == len(row.prompt.split()) + 15
    coded = code_batches(batches(spark, ["red"]), CATEGORIES, lambda: KeywordClient(False), settings)
    assert coded.first().status == "ok"


class CountingClient(KeywordClient):
    """Leaves one file per call in a folder."""

    def __init__(self, folder):
        super().__init__(is_multicode=False)
        self._folder = folder

    def complete(self, prompt):
        import os
        import uuid

        open(os.path.join(self._folder, uuid.uuid4().hex), "w").close()
        return super().complete(prompt)


def test_ledger_answers_each_prompt_once(spark, tmp_path):
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    folder = str(calls)
    many = batches(spark, *[[f"red {i}", f"blue {i}"] for i in range(23)])
    settings = replace(FAST, requests_per_task=3)
    first = code_batches(many.where("batch_id < 10"), CATEGORIES, lambda: CountingClient(folder), settings, ledger)
    assert first.count() == 10 and first.count() == 10  # two actions, no new calls
    assert len(list(calls.iterdir())) == 10
    rest = code_batches(many, CATEGORIES, lambda: CountingClient(folder), settings, ledger)
    assert rest.count() == 23
    assert len(list(calls.iterdir())) == 23
    assert read_ledger(spark, ledger).count() == 23
    again = code_batches(many, CATEGORIES, lambda: CountingClient(folder), settings, ledger)
    assert again.count() == 23 and len(list(calls.iterdir())) == 23


def test_failed_requests_are_tried_by_the_next_run(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    one = batches(spark, ["red"], ["blue"])
    down = code_batches(one, CATEGORIES, lambda: ScriptedClient([RuntimeError("down")]), FAST, ledger)
    assert {(r.status, r.last_error) for r in down.collect()} == {("error", "down")}
    up = code_batches(one, CATEGORIES, lambda: KeywordClient(False), FAST, ledger)
    assert sorted((r.responses[0], r.status, r.codes) for r in up.collect()) == [
        ("blue", "ok", [["Blue"]]), ("red", "ok", [["Red"]]),
    ]
    assert read_ledger(spark, ledger).count() == 4


def test_waves_hold_concurrency_and_survive_a_stop(spark, tmp_path):
    """A client that dies in a later wave leaves the earlier waves in the ledger."""
    ledger = str(tmp_path / "ledger")
    settings = replace(FAST, requests_per_task=2, max_attempts=1)

    class Dying(KeywordClient):
        def complete(self, prompt):
            if "red 9" in prompt:
                raise SystemExit("gone")  # not an Exception: ends the task
            return super().complete(prompt)

    many = batches(spark, *[[f"red {i}"] for i in range(12)])
    with pytest.raises(Exception, match="gone|SystemExit|Python worker"):
        code_batches(many, CATEGORIES, lambda: Dying(False), settings, ledger)
    assert read_ledger(spark, ledger).count() == 8
    done = code_batches(many, CATEGORIES, lambda: KeywordClient(False), settings, ledger)
    assert done.count() == 12 and done.where("status = 'ok'").count() == 12


def test_paced_requests_wait_for_their_time(spark):
    settings = CodingSettings(question="Why?", concurrency=2, calls_per_task=1, requests_per_minute=120)
    many = batches(spark, *[[f"red {i}"] for i in range(124)])
    requests = coding_requests(many, CATEGORIES, settings)
    start = time.time()
    ledger = run_requests(
        requests, lambda: KeywordClient(False), CodeReply(CATEGORIES), settings, scratch_path(spark, "paced")
    )
    assert ledger.count() == 124
    assert time.time() - start >= 2.0  # four requests beyond the first minute's 120


def test_speculation_is_refused(spark, monkeypatch):
    requests = coding_requests(batches(spark, ["red"]), CATEGORIES, FAST)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: "true")
    with pytest.raises(ValueError, match="speculation"):
        run_requests(requests, lambda: KeywordClient(False), CodeReply(CATEGORIES), FAST, "unused")


def coded(spark, *rows):
    return spark.createDataFrame(list(rows), "batch_id long, responses array<string>, codes array<array<string>>")


def test_codeframe_pairs_up_to_the_shorter_side(spark):
    df = coded(
        spark,
        (0, ["a", "b", "c"], [["X"], ["Y", "Z"]]),
        (1, ["d"], [["X"], ["Y"]]),
        (2, ["", "e"], [["X"], []]),
        (3, ["f"], []),
    )
    rows = {r.response: r.categories for r in build_codeframe(df, True).collect()}
    assert rows == {"a": ["X"], "b": ["Y", "Z"], "d": ["X"], "e": []}


def test_distinct_answers_need_no_shuffle(spark):
    df = coded(spark, (0, ["a", "b"], [["X"], ["Y"]]), (1, ["", "c"], [["X"], ["Z"]]))
    codeframe = build_codeframe(df, False, distinct=True)
    assert "Exchange" not in codeframe._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in codeframe.collect()} == {("a", "X"), ("b", "Y"), ("c", "Z")}


def test_last_batch_decides_a_repeated_answer(spark):
    df = coded(spark, (5, ["a"], [["New"]]), (1, ["a"], [["Old"]]), (5, ["b", "b"], [["1"], ["2"]]))
    rows = {r.response: r.category for r in build_codeframe(df, False).collect()}
    assert rows == {"a": "New", "b": "2"}


def test_codeframe_job_asks_about_distinct_answers(spark):
    rows = [("1", "Red!", "blue"), ("2", "red", None), ("3", "!!!", "Green")]
    df = spark.createDataFrame(rows, "id string, r1 string, r2 string")
    codeframe = create_codeframe(df, ["Red", "Blue", "Other", "Uncategorized"], lambda: KeywordClient(False), FAST)
    assert {tuple(r) for r in codeframe.collect()} == {("red", "Red"), ("blue", "Blue"), ("green", "Other")}
    with pytest.raises(ValueError, match="Uncategorized"):
        create_codeframe(df, ["Red"], lambda: KeywordClient(False), FAST)


def test_category_job(spark):
    df = spark.createDataFrame([("1", "Red one"), ("2", "blue two"), ("3", None)], "id string, r string")
    settings = CodingSettings(sample_size=2, paced=False, backoff_seconds=0.0)
    rows = generate_categories(df, FirstWordClient, settings).orderBy("ord").collect()
    assert {r.category for r in rows[:2]} == {"Red", "Blue"}
    assert [r.category for r in rows[2:]] == ["Other", "Bad response", "Uncategorized"]
    failed = generate_categories(df, lambda: ScriptedClient(['{"a": 1}']), settings).orderBy("ord")
    assert [r.category for r in failed.collect()] == ["Error", "Other", "Bad response", "Uncategorized"]
    kept = generate_categories(df, lambda: ScriptedClient(["no", '["X", 1]']), settings).orderBy("ord")
    assert [r.category for r in kept.collect()][:2] == ["X", "1"]


def test_hosted_client_sends_one_message(monkeypatch):
    import sys
    import types

    with pytest.raises(RuntimeError, match="openai"):
        monkeypatch.setitem(sys.modules, "openai", None)
        ChatClient()
    sent = []

    class Busy(Exception):
        pass

    class Completions:
        def create(self, **request):
            sent.append(request)
            if "busy" in str(request):
                raise Busy("later")
            message = types.SimpleNamespace(content=None if "empty" in str(request) else "hi")
            return types.SimpleNamespace(choices=[types.SimpleNamespace(message=message)])

    chat = types.SimpleNamespace(completions=Completions())
    fake = types.SimpleNamespace(OpenAI=lambda **_: types.SimpleNamespace(chat=chat), RateLimitError=Busy)
    monkeypatch.setitem(sys.modules, "openai", fake)
    assert ChatClient("m").complete("hello") == "hi"
    assert ChatClient("m").complete("empty") == ""
    with pytest.raises(RateLimited, match="later"):
        ChatClient("m").complete("busy")
    assert sent[0] == {"model": "m", "messages": [{"role": "user", "content": "hello"}]}


@pytest.mark.parametrize("limit", [140_000, 500, 300])
def test_themes_of_a_sample_over_the_limit(spark, limit):
    """Asked in parts, the stand-in names the same first words as when asked at once."""
    words = [f"word{'abcdefghij'[k % 7]}{'abcdefghij'[k % 10]}" for k in range(60)]
    sample = spark.createDataFrame([([f"{w} and some more text {k}" for k, w in enumerate(words)],)], "sample array<string>")
    for count in (20, 70):
        settings = replace(FAST, tokens_per_minute=limit, number_of_categories=count)
        found = propose_categories(sample, FirstWordClient, settings).orderBy("ord").collect()
        want = [w.capitalize() for w in dict.fromkeys(words)][:count]
        assert [r.category for r in found] == [*want, "Other", "Bad response", "Uncategorized"]
        assert [r.ord for r in found] == list(range(len(found)))


def test_only_a_single_answer_over_the_limit_fails(spark):
    settings = replace(FAST, tokens_per_minute=300)
    sample = spark.createDataFrame([(["red one", "x" * 2000, "blue two"],)], "sample array<string>")
    found = propose_categories(sample, FirstWordClient, settings).orderBy("ord").collect()
    assert [r.category for r in found] == ["Red", "Blue", "Error", "Other", "Bad response", "Uncategorized"]


@pytest.mark.parametrize("is_multicode", [False, True])
def test_a_grown_table_asks_about_new_answers_only(spark, tmp_path, is_multicode):
    settings = replace(FAST, is_multicode=is_multicode, batch_size=3)
    names, ledger = [*CATEGORIES, "Uncategorized"], str(tmp_path / "ledger")
    factory = lambda: KeywordClient(is_multicode)
    column = "categories" if is_multicode else "category"

    def rows(n):
        return spark.createDataFrame([(k, f"{'red' if k % 3 else 'blue'} {k}") for k in range(n)], "id long, r string")

    first = create_codeframe(rows(300), names, factory, settings, ledger)
    known = spark.createDataFrame(first.collect(), first.schema)
    assert read_ledger(spark, ledger).count() == 100
    # One entry failed and one has no code; both are asked about again, beside three new ones.
    failed = ["Error"] if is_multicode else "Error"
    rest = [(r.response, r[column]) for r in known.collect() if r.response not in ("red 1", "blue 3")]
    known = spark.createDataFrame([*rest, ("red 1", failed), ("blue 3", None)], first.schema)
    grown = extend_codeframe(known, rows(303), names, factory, settings, ledger).collect()
    assert read_ledger(spark, ledger).count() == 102
    whole = create_codeframe(rows(303), names, factory, settings).collect()
    assert sorted(map(tuple, grown)) == sorted(map(tuple, whole)) and len(grown) == 303
    # Nothing new: no request at all.
    again = extend_codeframe(spark.createDataFrame(whole), rows(303), names, factory, settings, ledger)
    assert again.count() == 303 and read_ledger(spark, ledger).count() == 102


def test_a_restart_reads_the_ledger_once_before_its_waves(spark, tmp_path, monkeypatch):
    """What is left to ask is worked out once, however many waves ask it."""
    ledger = str(tmp_path / "ledger")
    many = batches(spark, *[[f"red {i}"] for i in range(40)])
    code_batches(many.where("batch_id < 9"), CATEGORIES, lambda: KeywordClient(False), FAST, ledger)
    plans = []
    ask_model = inference.ask_model

    def watched(requests, *rest):
        plans.append(requests._jdf.queryExecution().optimizedPlan().toString())
        return ask_model(requests, *rest)

    monkeypatch.setattr(inference, "ask_model", watched)
    settings = replace(FAST, requests_per_task=2)
    assert code_batches(many, CATEGORIES, lambda: KeywordClient(False), settings, ledger).count() == 40
    assert len(plans) == 10 and not any("Join" in plan or "status" in plan for plan in plans)
    assert read_ledger(spark, ledger).count() == 40


def test_written_requests_hold_each_answer_once(spark):
    """A prompt is made of the answers again where it is asked."""
    batches = spark.createDataFrame([(0, ["a long answer", "another"]), (1, ["third"])], "batch_id long, responses array<string>")
    settings = CodingSettings(question="Why?")
    requests = with_request(batches, lambda r: coding_prompt(r, "Why?", ["A"], False), settings)
    written = spark.read.parquet(*requests.inputFiles())
    assert "prompt" not in written.columns and "responses" in written.columns
    keys = requests.select("request_key", F.md5(F.concat(F.lit(settings.reader_key + "\n"), "prompt")).alias("own")).collect()
    assert len(keys) == 2 and all(r.request_key == r.own for r in keys)


def test_a_wave_reads_its_own_run_of_each_file(spark):
    """Reading a run of the batches skips the pages of all others, so the waves together read the requests about once."""
    many = spark.range(8_000).select(F.col("id").alias("batch_id"), F.array(F.col("id").cast("string")).alias("responses"))
    requests = coding_requests(many, CATEGORIES, FAST)
    files = len(requests.inputFiles())
    wave = requests.where((F.col("batch_id") >= 4_000) & (F.col("batch_id") < 4_100)).select("request_key", "responses")
    assert sorted(int(r.responses[0]) for r in wave.collect()) == list(range(4_000, 4_100))
    scan = wave._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().apply("numOutputRows").value()
    assert 100 <= read <= 100 + 2 * inference.PAGE_ROWS * files and read < 1_000
