"""Parameters of a coding run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

# Names with a meaning of their own in the results.
UNCATEGORIZED = "Uncategorized"
FAILED = "Error"
DEFAULT_CATEGORIES = ("Other", "Bad response", "Uncategorized")


@dataclass(frozen=True)
class CodingSettings:
    """One frozen bundle of parameters, passed to jobs and to executor tasks.

    ``concurrency`` is the number of calls in flight over all tasks, of which a
    task keeps ``calls_per_task``. A wave is what is asked and written to the ledger
    at once: ``requests_per_task`` requests for each task, or more where there
    would be over ``most_waves`` waves. ``expected_reply_tokens`` is added to every
    request when the rate budget is planned, because replies are charged too but
    not known in advance; ``token_counter`` counts the tokens of prompts instead of
    the estimate. ``model`` names what is asked, and is part of the ledger's keys.
    ``ship_code`` sends the code of this package and of the client with the tasks;
    turn it off where the executors have both installed.
    """

    # Defaults that decide prompts, batches and limits.
    question: str = "your_questionnaire_question?"
    is_multicode: bool = False
    number_of_categories: int = 20
    sample_size: int = 200
    batch_size: int = 3
    max_attempts: int = 6
    requests_per_minute: int = 450
    tokens_per_minute: int = 140_000
    concurrency: int = 6

    # Own parameters.
    seed: str = "1"
    model: str = "gpt-4-turbo-preview"
    expected_reply_tokens: int = 60
    token_counter: Callable[[Column], Column] | None = None
    calls_per_task: int = 6
    requests_per_task: int = 1_000
    most_waves: int = 50
    ship_code: bool = True
    paced: bool = True
    backoff_seconds: float = 1.0
    backoff_limit_seconds: float = 60.0
    strict_length: bool = False
    fence_only: bool = False
    broadcast_bytes: int = 128 * 1024 * 1024

    @property
    def tasks(self) -> int:
        return -(-self.concurrency // self.calls_per_task)

    @property
    def reader_key(self) -> str:
        """What decides, next to the prompt, which replies are good."""
        return "|".join(map(str, (self.model, self.is_multicode, self.strict_length, self.fence_only)))
