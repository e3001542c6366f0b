"""Quality rules: counted base rules and a calibrated classifier of hashed n-grams.

*Base rules* are exact counts over the whole text (see ``judge_quality``).

*Classifier.* Words, word pairs and byte groups of 3 and 4 are hashed into buckets. A
text is the mean of its n-grams, so its score is the mean weight of its word n-grams
plus that of its byte n-grams. A logistic regression is trained on the driver on a
bounded sample of labelled rows, the same number of each class, by accelerated
gradient descent. A third of the sample is held out to calibrate the score to
probabilities (Platt scaling), weighted so that the classes stand as they do among all
labelled rows. Texts are then scored in Arrow batches with the weights, a table of
``2 * BUCKETS`` numbers, and kept from a fixed probability on.

Null texts have no words. Labels that are null, of unknown documents or neither 0
nor 1 are not used; without both classes every text that passes the base rules is
kept, with no probability. Repeated rows and null ids are returned as they are, other
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.arrow import binary_column, blobs, cut_by_bytes, map_texts
from themeloom.llm.minhash import mixed
from themeloom.llm.suffix import Names

BUCKETS = 1 << 15
ROWS_PER_CLASS = 1000  # of the sample the classifier is fitted on
KEEP_FROM = 0.5  # the probability of good quality from which a text is kept
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(word, len(known)) for word in words], dtype=np.int64)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def count_text(text: bytes | None) -> Counts:
    text = text or b""
    data = np.frombuffer(text, np.uint8)
    words = text.split()
    return Counts(
        len(words),
        int(np.count_nonzero(_LEADS[data] & ~_SPACE[data])),
        int(np.count_nonzero(_SYMBOL[data])),
        repeated_lines(text),
        repeated_words(words),
    )


class Grams(NamedTuple):
    """Buckets of n-grams and the text of each; word n-grams come from ``BUCKETS`` on."""

    bucket: np.ndarray
    text: np.ndarray


def _low_bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(49)).astype(np.int64)


def grams_of(texts: list[bytes | None]) -> list[Grams]:
    """The byte n-grams and the word n-grams of texts, kept apart."""
    data = np.frombuffer(b" ".join(text or b"" for text in texts), np.uint8)
    sizes = np.fromiter((len(text or b"") for text in texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    names = Names(data)
    kinds: list[Grams] = []
    buckets, owners = [], []
    for n in (3, 4):
        if len(data) >= n:
            owner = np.searchsorted(starts, np.arange(len(data) - n + 1), side="right") - 1
            inside = np.arange(len(data) - n + 1) + n <= (starts + sizes)[owner]
            buckets.append(_low_bits(names.all(n))[inside])
            owners.append(owner[inside])
    kinds.append(Grams(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (buckets, owners))))
    word = ~_SPACE[data]
    first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    last = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    owner = np.searchsorted(starts, first, side="right") - 1
    hashes = names.at(first, last)
    together = owner[1:] == owner[:-1]
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])[together]
    kinds.append(
        Grams(
            np.concatenate([_low_bits(hashes), _low_bits(pairs)]) + BUCKETS,
            np.concatenate([owner, owner[1:][together]]),
        )
    )
    return kinds


def mean_weights(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    total = np.zeros(len(texts))
    for grams in grams_of(texts):
        n = np.bincount(grams.text, minlength=len(texts))
        total += np.bincount(grams.text, weights=weights[grams.bucket], minlength=len(texts)) / np.maximum(n, 1)
    return total


class Model(NamedTuple):
    weights: np.ndarray
    slope: float
    offset: float

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        return _sigmoid(self.slope * mean_weights(texts, self.weights) + self.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


FEATURE_SCHEMA = "doc_id long, quality int, buckets binary, shares binary"


def _feature_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as its distinct buckets and the share of each among its n-grams."""
    for batch in cut_by_bytes(batches, "text", 1 << 19):
        texts = blobs(batch.column("text"))
        keys, shares = [], []
        for grams in grams_of(texts):
            key, n = np.unique(grams.text * (2 * BUCKETS) + grams.bucket, return_counts=True)
            total = np.bincount(grams.text, minlength=len(texts))
            keys.append(key)
            shares.append(n / total[key // (2 * BUCKETS)])
        key, share = np.concatenate(keys), np.concatenate(shares)
        order = np.argsort(key, kind="stable")
        key, share = key[order], share[order]
        sizes = np.bincount(key // (2 * BUCKETS), minlength=len(texts))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("quality"),
                binary_column((key % (2 * BUCKETS)).astype("<i4"), sizes),
                binary_column(share.astype("<f4"), sizes),
            ],
            ["doc_id", "quality", "buckets", "shares"],
        )


def _fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, ridge: float, steps: int):
    """Weights and offset of a logistic regression on a sparse matrix, by accelerated gradient descent."""
    n = len(target)

    def times(w):
        return np.bincount(rows, weights=values * w[columns], minlength=n)

    def back(g):
        return np.bincount(columns, weights=values * g[rows], minlength=2 * BUCKETS)

    probe = np.random.default_rng(0).normal(size=2 * BUCKETS)
    for _ in range(8):
        probe = back(times(probe / np.linalg.norm(probe)))
    step = 1.0 / (0.25 * np.linalg.norm(probe) / n * 1.1 + 0.25 + ridge)
    w, b = np.zeros(2 * BUCKETS), 0.0
    ahead_w, ahead_b, momentum = w, b, 1.0
    for _ in range(steps):
        error = _sigmoid(times(ahead_w) + ahead_b) - target
        new_w = ahead_w - step * (back(error) / n + ridge * ahead_w)
        new_b = ahead_b - step * float(error.mean())
        new_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        rate = (momentum - 1) / new_momentum
        ahead_w, ahead_b = new_w + rate * (new_w - w), new_b + rate * (new_b - b)
        w, b, momentum = new_w, new_b, new_momentum
    return w, b


def _platt(z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, by Newton steps with smoothed targets."""
    good, bad = target.sum(), (1 - target).sum()
    smooth = np.where(target > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g = weight * (p - smooth)
        h = weight * p * (1 - p)
        gradient = np.array([(g * z).sum(), g.sum()])
        hessian = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -5, 5)
    return float(a), float(b)


def train(
    documents: DataFrame,
    labels: DataFrame,
    rows_per_class: int = ROWS_PER_CLASS,
    scale: float = 10.0,
    ridge: float = 1e-4,
    steps: int = 200,
) -> Model | None:
    """A model from at most ``rows_per_class`` labelled rows of each class, or None without both classes."""
    rated = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    sizes = {row.quality: row.n for row in rated.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    order = F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")
    sample = None
    for quality in (0, 1):
        some = rated.where(F.col("quality") == quality).orderBy(*order).limit(rows_per_class)
        sample = some if sample is None else sample.unionByName(some)
    # The sample has at most two times rows_per_class rows, and each brings one text however often its id repeats.
    asked = F.broadcast(sample.select("doc_id").distinct())
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, "doc_id")
    texts = found.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(sample), "doc_id")
    features = map_texts(texts.select("doc_id", "quality", "text"), _feature_task, FEATURE_SCHEMA)
    found = features.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    target = np.array(found.column("quality").to_pylist(), dtype=np.float64)
    held = np.arange(len(target)) % 3 == 0
    if any(len(set(target[part])) < 2 for part in (held, ~held)):
        return None
    buckets = [np.frombuffer(x.as_py(), "<i4") for x in found.column("buckets")]
    shares = [np.frombuffer(x.as_py(), "<f4") for x in found.column("shares")]
    own = np.flatnonzero(~held)
    w, b = _fit(
        np.repeat(np.arange(len(own)), [len(buckets[k]) for k in own]),
        np.concatenate([buckets[k] for k in own]),
        np.concatenate([shares[k] for k in own]) * scale,
        target[own],
        ridge,
        steps,
    )
    z = np.array([scale * shares[k] @ w[buckets[k]] + b for k in np.flatnonzero(held)])
    known = target[held]
    weight = np.where(known > 0, sizes[1] / max(known.sum(), 1), sizes[0] / max((1 - known).sum(), 1))
    slope, offset = _platt(z, known, weight / weight.sum() * len(known))
    return Model(scale * w, slope, slope * b + offset)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, probability double, kept boolean"
)


def _verdicts(texts: list[bytes | None], model: Model | None, keep_from: float):
    """Counts, base failures, probabilities (None without a model) and verdicts."""
    counts = np.array([count_text(text) for text in texts], dtype=np.int64).reshape(len(texts), 5)
    failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED_PERCENT * counts[:, 0])
    p = model.probabilities(texts) if model else None
    return counts, failed, p, ~failed if p is None else ~failed & (p >= keep_from)


def judge_quality(
    documents: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, rows_per_class: int = ROWS_PER_CLASS
) -> DataFrame:
    """Per row: the base counts, ``base_failed``, the ``probability`` of good quality, and ``kept``.

    ``n_words`` words split at ASCII white space, ``word_chars`` code points in words,
    ``n_symbols`` characters of ``#*$%&|<>``, ``n_dup_lines`` lines with a word that equal
    an earlier line, ``n_repeat_words`` words in windows of three words found twice or
    more. A text fails with fewer than 50 words or if more than half of them repeat.
    """
    model = train(documents, labels, rows_per_class)

    def run(batches):
        for batch in cut_by_bytes(batches, "text", 1 << 19):
            counts, failed, p, kept = _verdicts(blobs(batch.column("text")), model, keep_from)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *(pa.array(counts[:, k]) for k in range(5)),
                    pa.array(failed),
                    pa.nulls(batch.num_rows, pa.float64()) if p is None else pa.array(p),
                    pa.array(kept),
                ],
                [part.split()[0] for part in SCHEMA.split(", ")],
            )

    return map_texts(documents.select("doc_id", "text"), run, SCHEMA)


def kept_documents(
    documents: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, rows_per_class: int = ROWS_PER_CLASS
) -> DataFrame:
    """The rows of the documents that ``judge_quality`` keeps, with all their columns."""
    model = train(documents, labels, rows_per_class)

    def run(batches):
        for batch in cut_by_bytes(batches, "text", 1 << 19):
            *_, kept = _verdicts(blobs(batch.column("text")), model, keep_from)
            yield batch.filter(pa.array(kept))

    return map_texts(documents, run, documents.schema)
