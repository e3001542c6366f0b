"""Token ids of whole texts, one tokenizer call for many distinct words of a task."""

from __future__ import annotations

import itertools
import os

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from themeloom.llm.arrow import held

DEFAULT_TOKENIZER = "word_bpe_49k.json"
END_ID = 2

# A word that is one token wherever it stands; words that hold it are encoded alone.
MARK = b"0"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, so words can be encoded apart.

    Words are split at ASCII white space only, which no token spans. Each distinct
    word is encoded once; the memory starts anew once its words take ``most_bytes``.
    A word differs from its ASCII lower case only by what the tokenizer lowers itself,
    and a comma or full stop after a letter or digit is a token of its own.
    """

    def __init__(self, path: str, most_bytes: int = 96 << 20):
        # A task has one core; more threads would only take memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.most_bytes = most_bytes
        self._forget()

    def _forget(self) -> None:
        self.held = 0
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.begins = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def _apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each."""
        parts = []
        # A few thousand words at a time, as encodings take far more room than their ids.
        for at in range(0, len(words), 4096):
            texts = [
                b" ".join(word + b" " + MARK for word in words[k : min(k + 256, at + 4096)]).decode()
                for k in range(at, min(at + 4096, len(words)), 256)
            ]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            parts += [np.array(e.ids, dtype=np.uint32) for e in found]
        ids = np.concatenate(parts)
        is_mark = ids == self.mark
        ends = np.flatnonzero(is_mark)
        if len(ends) != len(words):
            raise ValueError("this tokenizer cannot encode words apart")
        return ids[~is_mark], np.diff(ends, prepend=-1) - 1

    def _learn(self, first: int) -> None:
        """Ids of the words not met before."""
        words = list(itertools.islice(self.known, first, None))
        # A word's place in the dictionary, its object and its ids take about 150 bytes more than its letters.
        self.held += sum(map(len, words)) + 150 * len(words)
        bases: dict[bytes, int] = {}
        alone, base_of, closing = [], [], []
        for k, word in enumerate(words):
            if MARK in word or b"<|" in word:
                alone.append(k)
                base_of.append(-1)
                closing.append(0)
                continue
            end = word[-1:] if word[-1:] in b",." and word[-2:-1].isalnum() else b""
            base = (word[:-1] if end else word).lower()
            base_of.append(bases.setdefault(base, len(bases)))
            closing.append((b",", b".").index(end) + 1 if end else 0)
        if not words:
            return
        ids, counts = self._apart([b",", b".", *bases])
        starts = np.cumsum(counts) - counts
        ones = [np.array(self.tokenizer.encode(words[k].decode(), add_special_tokens=False).ids) for k in alone]
        base = np.array(base_of) + 2
        lengths = np.where(base > 1, counts[base], 0)
        closing = np.array(closing)
        lengths += closing > 0
        lengths[alone] = [len(one) for one in ones]
        begins = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), dtype=np.uint32)
        body = np.where(base > 1, lengths - (closing > 0), 0)
        into = np.repeat(begins, body) + np.arange(int(body.sum())) - np.repeat(np.cumsum(body) - body, body)
        flat[into] = ids[np.repeat(starts[base], body) + into - np.repeat(begins, body)]
        ended = closing > 0
        flat[begins[ended] + lengths[ended] - 1] = ids[closing[ended] - 1]
        for k, one in zip(alone, ones):
            flat[begins[k] : begins[k] + len(one)] = one
        self.begins = np.concatenate([self.begins, len(self.flat) + begins])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, ``end_id`` after each text, and where each text begins."""
        if self.held > self.most_bytes:
            self._forget()
        first, known = len(self.known), self.known
        rows = [[known.setdefault(word, len(known)) for word in (text or b"").split()] for text in texts]
        self._learn(first)
        counts = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        words = np.fromiter(itertools.chain.from_iterable(rows), dtype=np.int64, count=int(counts.sum()))
        lengths = self.lengths[words]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        # Where each id lies in the flat array of known words.
        places = np.repeat(self.begins[words] - (ends - lengths), lengths) + np.arange(total)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        begins = upto + np.arange(len(upto))
        ids = np.empty(int(begins[-1]), dtype=np.uint32)
        is_end = np.zeros(len(ids), dtype=bool)
        is_end[begins[1:] - 1] = True
        ids[is_end] = end_id
        ids[~is_end] = self.flat[places]
        return ids, begins


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of a Python worker, which serves many tasks: the words of one are known to the next.

    A task of an operator that does not name it in ``keeps`` lets it go.
    """
    return held(path, lambda: WordEncoder(path))
