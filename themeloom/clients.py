"""What executor tasks call to get a reply, and stand-ins for tests and queries.

A job is given a *factory*: a picklable function of no arguments, run once per
task, that returns an object with ``complete(prompt) -> str``.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Sequence
from typing import Protocol


class RateLimited(Exception):
    """Raised by a client when the service asks to slow down."""


class ModelClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class ChatClient:
    """A hosted chat model through the public ``openai`` package, where installed.

    The key comes from the environment of the executors, as that package reads it.
    """

    # Fixed value: the model asked by default.
    MODEL = "gpt-4-turbo-preview"

    def __init__(self, model: str = MODEL):
        try:
            import openai
        except ImportError as error:
            raise RuntimeError("ChatClient needs the openai package on the executors") from error
        self._model = model
        self._slow_down = openai.RateLimitError
        self._chat = openai.OpenAI(max_retries=0).chat.completions

    def complete(self, prompt: str) -> str:
        try:
            answer = self._chat.create(model=self._model, messages=[{"role": "user", "content": prompt}])
        except self._slow_down as error:
            raise RateLimited(str(error)) from error
        return answer.choices[0].message.content or ""


class KeywordClient:
    """Stand-in for a hosted model: codes by category name occurring in the answer.

    Reads answers and categories back from a coding prompt. An answer gets every
    category whose lower-case name it contains, in list order, else ``Other``;
    the single form takes the first.
    """

    def __init__(self, is_multicode: bool):
        self._is_multicode = is_multicode

    def complete(self, prompt: str) -> str:
        body = prompt.split("Responses:\n    `", 1)[1]
        answers, rest = body.split("`\n    \n    categories:\n    ```\n    ", 1)
        categories = rest.rsplit("\n    ```", 1)[0].split("\n")
        codes = []
        for line in answers.split("\n"):
            answer = re.sub(r"^\d+: ", "", line)
            hits = [c for c in categories if c.lower() in answer] or ["Other"]
            codes.append(hits if self._is_multicode else hits[0])
        return f"```json\n{json.dumps(codes)}\n```"


class FirstWordClient:
    """Stand-in for a hosted model: themes are the first words of the sample.

    Words count once, in sample order and capitalised, up to the number asked for.
    """

    def complete(self, prompt: str) -> str:
        count = int(re.match(r"List the (\d+) ", prompt).group(1))
        sample = ast.literal_eval(prompt.split("Responses:\n    ```\n    ", 1)[1].rsplit("\n    ```", 1)[0])
        words = dict.fromkeys(text.split(" ")[0].capitalize() for text in sample)
        return json.dumps(list(words)[:count])


class ScriptedClient:
    """Stand-in for a hosted model: gives the listed replies in turn, then the last.

    An exception in the list is raised instead of returned.
    """

    def __init__(self, replies: Sequence[str | Exception]):
        self._replies = list(replies)

    def complete(self, prompt: str) -> str:
        reply = self._replies.pop(0) if len(self._replies) > 1 else self._replies[0]
        if isinstance(reply, Exception):
            raise reply
        return reply
