"""Asking a model from Spark tasks, with retries and a ledger of paid replies."""

from __future__ import annotations

import contextlib
import itertools
import json
import random
import sys
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.clients import ModelClient, RateLimited
from themeloom.config import FAILED, CodingSettings
from themeloom.functions.prompts import coding_prompt, estimate_tokens
from themeloom.functions.replies import REPLY_NOISE
from themeloom.operators.budget import BLOCK_ROWS, plan_requests
from themeloom.tables import materialize

OVER_LIMIT = "over_token_limit"

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("request_key", T.StringType()),
        T.StructField("codes", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("reply", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("last_error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class CodeReply:
    """Reads a coding reply: a list of codes, or of lists of codes, all known."""

    categories: Sequence[str]
    is_multicode: bool = False
    strict_length: bool = False

    def read(self, value: object, answers: int) -> list[list[str]]:
        if not isinstance(value, list):
            raise ValueError("not_a_list")
        groups = value if self.is_multicode else [value]
        if not all(isinstance(group, list) for group in groups):
            raise ValueError("not_a_list_of_lists")
        for group in groups:
            if not all(isinstance(code, str) for code in group):
                raise ValueError("not_a_string")
            if not set(group) <= set(self.categories):
                raise ValueError("unknown_category")
        if self.strict_length and len(value) != answers:
            raise ValueError("wrong_length")
        return value if self.is_multicode else [[code] for code in value]


@dataclass(frozen=True)
class ThemeReply:
    """Reads a list of theme names, of any length."""

    def read(self, value: object, answers: int) -> list[list[str]]:
        if not isinstance(value, list):
            raise ValueError("not_a_list")
        return [[name if isinstance(name, str) else json.dumps(name)] for name in value]


def strip_reply_text(reply: str, fence_only: bool = False) -> str:
    """The in-task twin of the ``strip_reply`` expression."""
    reply = reply.strip()
    if fence_only:
        reply = reply.removeprefix("```").removeprefix("json") if reply.startswith("```") else reply
        return reply.removesuffix("```").strip().replace("\n", "")
    for token in REPLY_NOISE:
        reply = reply.replace(token, "")
    return reply


def _back_off(settings: CodingSettings, tries: int) -> None:
    """A random wait of up to twice as long after each try."""
    longest = min(settings.backoff_limit_seconds, settings.backoff_seconds * 2 ** min(tries, 30))
    time.sleep(random.uniform(0, longest))


class Pace:
    """When the calls of one task may be sent.

    First calls go at their planned times, counted from one start for all tasks; a
    call that is late moves all later ones, so nothing is caught up in a burst. Any
    further call, after a failure or after being told to slow down, waits for the
    time the whole service needs to recover from it, times the number of tasks, and
    moves the task's later calls by as much: the task pays from its own share of the
    limits. A task that runs again asks all over at that distance, without credit.
    """

    def __init__(self, settings: CodingSettings, started: float, again: bool):
        self._settings, self._started, self._again = settings, started, again
        self._late, self._next, self._lock = 0.0, 0.0, threading.Lock()

    def hold(self, cost: int) -> float:
        """Seconds of this task's share of the limits that a call takes."""
        minutes = max(cost / self._settings.tokens_per_minute, 1 / self._settings.requests_per_minute)
        return 60.0 * minutes * self._settings.tasks

    def send_time(self, request, first: bool, now: float) -> float:
        with self._lock:
            if first and not self._again:
                planned = self._started + request.admit_us / 1e6 + self._late
                self._late += max(0.0, now - planned)
                return max(now, planned)
            at = self._next = max(now, self._next) + self.hold(request.cost)
            self._late += self.hold(request.cost)
            return at

    def wait(self, request, first: bool) -> None:
        if self._settings.paced:
            now = time.time()
            time.sleep(max(0.0, self.send_time(request, first, now) - now))


def _complete(client: ModelClient, request, settings: CodingSettings, pace: Pace, first: bool) -> str:
    """The client's reply; being asked to slow down is waited out."""
    for wait in itertools.count():
        pace.wait(request, first and wait == 0)
        try:
            return client.complete(request.prompt)
        except RateLimited:
            _back_off(settings, wait)


def _ask(client: ModelClient, request, reader: CodeReply | ThemeReply, settings: CodingSettings, pace: Pace) -> tuple:
    """One ledger row: ask until a reply passes, at most ``max_attempts`` times."""
    failed = [[FAILED]] * request.answers
    if request.oversize:
        return request.request_key, failed, None, 0, "error", OVER_LIMIT
    reply, error = None, None
    for attempt in range(1, settings.max_attempts + 1):
        try:
            reply = _complete(client, request, settings, pace, attempt == 1)
            if not reply:
                raise ValueError("empty_reply")
            try:
                value = json.loads(strip_reply_text(reply, settings.fence_only))
            except ValueError:
                raise ValueError("not_json") from None
            codes = reader.read(value, request.answers)
            return request.request_key, codes, reply, attempt, "ok", error
        except Exception as problem:  # any failure of the service counts as an attempt
            error = str(problem) or type(problem).__name__
        if attempt < settings.max_attempts:
            _back_off(settings, attempt - 1)
    return request.request_key, failed, reply, settings.max_attempts, "error", error


@contextlib.contextmanager
def _shipped(client_factory: Callable[[], ModelClient], ship: bool) -> Iterator[None]:
    """Within this, functions of this package and of the client's module go to the tasks by value."""
    names = {"themeloom", getattr(client_factory, "func", client_factory).__module__} if ship else set()
    modules = [sys.modules[n] for n in names if n.split(".")[0] not in sys.stdlib_module_names]
    for module in modules:
        cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        for module in modules:
            cloudpickle.unregister_pickle_by_value(module)


def ask_model(
    requests: DataFrame,
    client_factory: Callable[[], ModelClient],
    reader: CodeReply | ThemeReply,
    settings: CodingSettings,
    started: float | None = None,
) -> DataFrame:
    """Ledger rows for requests that hold a prompt, a cost and an admission time.

    Each task asks its requests in admission order and keeps ``calls_per_task`` of
    them in flight, every thread with a client of its own. Evaluating the result
    calls the model: write it before using it.
    """
    started = time.time() if started is None else started
    settings = replace(settings, token_counter=None)  # needed on the driver only

    def ask_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        pace = Pace(settings, started, again=bool(context and context.attemptNumber()))
        own = threading.local()

        def ask(request) -> tuple:
            if not hasattr(own, "client"):
                own.client = client_factory()
            return _ask(own.client, request, reader, settings, pace)

        with ThreadPoolExecutor(settings.calls_per_task) as pool:
            for frame in frames:
                run = map if settings.calls_per_task == 1 else pool.map
                rows = list(run(ask, frame.itertuples(index=False)))
                yield pd.DataFrame(rows, columns=LEDGER_SCHEMA.names)

    return (
        requests.select("request_key", "prompt", "answers", "oversize", "admit_us", "cost")
        .repartition(settings.tasks, "request_key")
        .sortWithinPartitions("admit_us")
        .mapInPandas(ask_partition, LEDGER_SCHEMA)
    )


PART_BITS = 20  # of a request's number that tell the parts of one batch
PAGE_ROWS = 128  # requests of one page, the least that a wave reads of a file


def with_request(
    batches: DataFrame, prompt_of: Callable[[Column], Column], settings: CodingSettings, split: bool = True
) -> DataFrame:
    """The requests for batches, written once, sorted by batch within each file.

    ``prompt_of`` makes the prompt of an array of answers. With ``split``, a batch
    whose prompt is over the token limit is asked answer by answer; only a single
    answer that is over it itself stays ``oversize``. ``request_no`` numbers the requests in order, and
    ``request_key`` tells prompts, model and reading of the reply apart.
    """
    count = settings.token_counter or estimate_tokens

    def cost(prompt: Column) -> Column:
        return (count(prompt) + settings.expected_reply_tokens).cast("long")

    groups = F.array("responses")
    if split:
        fits = (cost(prompt_of(F.col("responses"))) <= settings.tokens_per_minute) | (F.size("responses") < 2)
        groups = F.when(fits, groups).otherwise(F.transform("responses", lambda response: F.array(response)))
    parts = batches.select("*", F.posexplode(groups).alias("part", "_part"))
    asked = parts.select(
        "batch_id",
        (F.shiftleft("batch_id", PART_BITS) + F.col("part")).alias("request_no"),
        F.col("_part").alias("responses"),
        prompt_of(F.col("_part")).alias("prompt"),
    )
    asked = asked.select(
        "batch_id",
        "request_no",
        "responses",
        F.md5(F.concat(F.lit(settings.reader_key + "\n"), F.col("prompt"))).alias("request_key"),
        F.size("responses").alias("answers"),
        cost(F.col("prompt")).alias("cost"),
    )
    # A prompt holds the answers once more, so it is not written but made again where it is read.
    # Each wave reads a run of the batches, which lie in pages of their own in each file.
    asked = materialize(asked.sortWithinPartitions("request_no"), "requests", texts=True, page_rows=PAGE_ROWS)
    return asked.withColumn("prompt", prompt_of(F.col("responses")))


def coding_requests(batches: DataFrame, categories: Sequence[str], settings: CodingSettings) -> DataFrame:
    """One request per batch, with a prompt that asks for its codes."""

    def prompt_of(responses: Column) -> Column:
        return coding_prompt(responses, settings.question, categories, settings.is_multicode)

    return with_request(batches, prompt_of, settings)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def best_replies(ledger: DataFrame) -> DataFrame:
    """One ledger row per request: a good reply where there is one."""
    row = F.struct(*LEDGER_SCHEMA.names[1:])
    rank = F.struct(F.col("status") == "ok", F.col("attempts"), F.col("reply"))
    best = ledger.groupBy("request_key").agg(F.max_by(row, rank).alias("_row"))
    return best.select("request_key", "_row.*")


def run_requests(
    requests: DataFrame,
    client_factory: Callable[[], ModelClient],
    reader: CodeReply | ThemeReply,
    settings: CodingSettings,
    ledger_path: str,
    start_full: bool = True,
) -> DataFrame:
    """Have every request answered, and return the best ledger row of each.

    ``requests`` is a table written by ``with_request``. The ledger is a Parquet
    table. Requests with a good reply in it are not asked again, so a run that
    died goes on where its last finished wave ended, and a later run tries those
    that failed. Waves are runs of the request order; each is one Spark job, and
    there are at most ``most_waves``. The first starts with a full minute of
    credit (unless not ``start_full``), later ones go on at the steady rate. The write is the only evaluation
    of the calls.
    """
    spark = requests.sparkSession
    if spark.conf.get("spark.speculation", "false").lower() == "true":
        raise ValueError("speculative tasks would pay for calls twice: turn spark.speculation off")
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(ledger_path)
    answered = read_ledger(spark, ledger_path).where(F.col("status") == "ok").select("request_key")
    pending = requests
    if not answered.isEmpty():
        # Written once, in the order of the waves: each reads its own run of files, and none the ledger.
        left = requests.join(answered, "request_key", "left_anti")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        left = left.repartitionByRange(parts, "request_no").sortWithinPartitions("request_no")
        pending = materialize(left, "pending")
    first, last = requests.agg(F.min("batch_id"), F.max("batch_id")).first()
    # Waves are equal runs of batch numbers, which have no gaps but where a caller leaves them.
    span = 0 if first is None else last - first + 1
    width = max(settings.tasks * settings.requests_per_task, -(-span // settings.most_waves))
    for start in range(0, span, width):
        low, high = first + start, min(first + start + width, last + 1)
        asked = pending.where((F.col("batch_id") >= low) & (F.col("batch_id") < high))
        if settings.paced:
            planned = plan_requests(
                asked,
                settings.tokens_per_minute,
                settings.requests_per_minute,
                order="request_no",
                start_full=start_full and start == 0,
                block_rows=BLOCK_ROWS << PART_BITS,
            )
        else:
            planned = asked.select(
                "*",
                (F.col("cost") > settings.tokens_per_minute).alias("oversize"),
                F.lit(0).cast("long").alias("admit_us"),
            )
        with _shipped(client_factory, settings.ship_code):
            ask_model(planned, client_factory, reader, settings).write.mode("append").parquet(ledger_path)
    return best_replies(read_ledger(spark, ledger_path))
