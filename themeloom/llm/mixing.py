"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Each dimension has target
shares of the tokens; values without a target of their own share the group ``other``,
so the number of cells is bounded by the targets given. One pass over the documents
counts the tokens of each cell; the table of cells is fitted by turns to each
dimension's targets until all hold. A cell's wanted tokens over its tokens is the
weight of its documents. There are two draws, and each is expected to spend the
``budget``, a share of all tokens:

* with repetition: a document is expected ``expected_copies`` times, its weight times
  the budget. That is above 1 where a cell has fewer tokens than its share, so the
  targets hold. ``copies`` is the whole part, and one more if the hash of the id falls
  below the rest;
* without: the ``probability`` of a document is its weight times a factor, at most 1.
  Cells that reach 1 stay below their share and the others make up for it, so the
  targets do not hold. A document is ``kept`` if the hash falls below the probability.

``attained_shares`` gives both draws' shares next to the targets. Both take equal ids
together, and any run on any cluster draws the same.

The ``topic`` is one of ``TOPICS`` groups of words (by a hash of the lowered word): the
one with most words of the whole text, the first among equals. Tokens are words
split at ASCII white space.

Null sources and languages belong to ``other``. Null and blank texts have no tokens and
topic 0; a document without tokens is in a cell like any other and weighs nothing.
Targets of groups that have no tokens are left out and the others scaled up. A null
``doc_id`` is drawn by the hash of nothing else than null. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.arrow import blobs, cut_by_bytes, map_texts
from themeloom.tables import column

TOPICS = 8
OTHER = "other"
DIMENSIONS = ("source", "lang", "topic")

# Production targets: shares of tokens.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.24, **{f"src{k}": 0.04 for k in range(1, 19)}},
    "lang": {"en": 0.54, "de": 0.17, "fr": 0.16, "es": 0.12},
    "topic": {str(k): 1 / TOPICS for k in range(TOPICS)},
}
BUDGET = 0.7


class TopicCounter:
    """Tokens and topic of texts; a word's group is worked out once per task."""

    def __init__(self, most_words: int = 150_000):
        self.most_words = most_words
        self.known: dict[bytes, int] = {}
        self.groups = np.zeros(0, dtype=np.int64)

    def count(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most_words:
            self.__init__(self.most_words)
        first, known = len(self.known), self.known
        rows = [[known.setdefault(w, len(known)) for w in (t or b"").lower().split()] for t in texts]
        new = (xxhash.xxh3_64_intdigest(w) % TOPICS for w in itertools.islice(known, first, None))
        self.groups = np.concatenate([self.groups, np.fromiter(new, dtype=np.int64)])
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        words = np.fromiter(itertools.chain.from_iterable(rows), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        table = np.bincount(owner * TOPICS + self.groups[words], minlength=len(rows) * TOPICS)
        return sizes, table.reshape(len(rows), TOPICS).argmax(axis=1) if len(rows) else sizes


def _topic_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = TopicCounter()
    for batch in cut_by_bytes(batches, "text", 2 << 20):
        tokens, topics = counter.count(blobs(batch.column("text")))
        columns = [batch.column(k) for k in range(batch.num_columns)]
        names = list(batch.schema.names)
        columns[names.index("text")] = pa.array(tokens)
        columns.append(pa.array([str(t) for t in topics.tolist()], pa.string()))
        names[names.index("text")] = "tokens"
        yield pa.RecordBatch.from_arrays(columns, [*names, "topic"])


def cells_of(documents: DataFrame) -> DataFrame:
    """``doc_id, source, lang, tokens, topic`` of each document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return map_texts(rows, _topic_task, "doc_id long, source string, lang string, tokens long, topic string")


def grouped(name: str, targets: dict[str, float]) -> Column:
    return F.when(F.col(name).isin(list(targets)), F.col(name)).otherwise(OTHER)


def rake(tokens: np.ndarray, shares: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """The table closest to ``tokens`` whose shares along each axis are those given.

    Groups without tokens cannot be given any; the other shares of their axis are scaled up.
    """
    fitted = tokens.astype(np.float64)
    if not fitted.sum():
        return fitted
    fitted /= fitted.sum()
    axes = range(tokens.ndim)
    others = [tuple(a for a in axes if a != axis) for axis in axes]
    wanted = []
    for axis in axes:
        possible = np.where(tokens.sum(axis=others[axis]) > 0, shares[axis], 0.0)
        if not possible.sum():
            possible = tokens.sum(axis=others[axis]).astype(np.float64)
        wanted.append(possible / possible.sum())
    for _ in range(rounds):
        off = 0.0
        for axis in axes:
            have = fitted.sum(axis=others[axis])
            off = max(off, float(np.abs(have - wanted[axis]).max()))
            factor = np.divide(wanted[axis], have, out=np.zeros_like(have), where=have > 0)
            fitted *= factor.reshape([-1 if a == axis else 1 for a in axes])
        if off < tolerance:
            break
    return fitted


def probabilities(tokens: np.ndarray, fitted: np.ndarray, budget: float) -> np.ndarray:
    """Per cell the least of 1 and a multiple of its weight, so that the expected tokens are the budget."""
    weight = np.divide(fitted, tokens, out=np.zeros_like(fitted), where=tokens > 0)
    wanted = min(budget, 1.0) * tokens[weight > 0].sum()
    if not wanted:
        return np.zeros_like(weight)
    # The cells in the order in which they reach 1; between two of them the total grows evenly.
    order = np.argsort(-weight, axis=None, kind="stable")
    w, t = weight.ravel()[order], tokens.ravel()[order].astype(np.float64)
    w, t = w[w > 0], t[: int((w > 0).sum())]
    full = np.concatenate([[0.0], np.cumsum(t)])
    part = np.concatenate([np.cumsum((w * t)[::-1])[::-1], [0.0]])
    for k in range(len(w) + 1):
        factor = (wanted - full[k]) / part[k] if part[k] > 0 else np.inf
        if k == len(w) or factor * w[k] <= 1:
            break
    return np.minimum(1.0, weight * factor) if np.isfinite(factor) else (weight > 0).astype(np.float64)


def _fitted_cells(
    cells: DataFrame, targets: dict[str, dict[str, float]], budget: float
) -> list[tuple[str, str, str, float, float, float, float]]:
    """``source, lang, topic, weight, probability, expected copies, tokens`` of each cell that documents fall into."""
    groups = [grouped(name, targets[name]).alias(name) for name in DIMENSIONS]
    rows = cells.select(*groups, "tokens").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).collect()
    values = [[*targets[name], OTHER] for name in DIMENSIONS]
    tokens = np.zeros([len(v) for v in values])
    at = {(r.source, r.lang, r.topic): tuple(v.index(r[name]) for v, name in zip(values, DIMENSIONS)) for r in rows}
    for r in rows:
        tokens[at[r.source, r.lang, r.topic]] = r.tokens or 0
    shares = [np.array([*targets[name].values(), max(0.0, 1 - sum(targets[name].values()))]) for name in DIMENSIONS]
    fitted = rake(tokens, shares)
    chance = probabilities(tokens, fitted, budget)
    weight = np.divide(fitted * tokens.sum(), tokens, out=np.zeros_like(fitted), where=tokens > 0)
    copies = weight * min(budget, 1.0)
    return [
        (*key, float(weight[place]), float(chance[place]), float(copies[place]), float(tokens[place]))
        for key, place in sorted(at.items())
    ]


def mixing_table(
    cells: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET
) -> list[tuple[str, str, str, float, float, float]]:
    """``source, lang, topic, weight, probability, expected copies`` of each cell that documents fall into."""
    return [row[:6] for row in _fitted_cells(cells, targets, budget)]


def attained_shares(
    documents: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET
) -> list[tuple[str, str, float, float, float, float]]:
    """``dimension, value, target, share of the documents, share with repetition, share without`` as expected."""
    rows = _fitted_cells(cells_of(documents), targets, budget)
    report = []
    for axis, name in enumerate(DIMENSIONS):
        for value in [*targets[name], OTHER]:
            target = targets[name].get(value, max(0.0, 1 - sum(targets[name].values())))
            shares = []
            for factor in (lambda r: 1.0, lambda r: r[5], lambda r: r[4]):
                all_tokens = sum(r[6] * factor(r) for r in rows)
                shares.append(sum(r[6] * factor(r) for r in rows if r[axis] == value) / all_tokens if all_tokens else 0.0)
            report.append((name, value, target, *shares))
    return report


def drawn_copies(draw: Column, expected: Column) -> Column:
    """A whole number of copies: the whole part of those expected, and one more if the draw is below the rest."""
    return (F.floor(expected) + (draw < expected - F.floor(expected)).cast("long")).cast("long")


def draw_documents(
    documents: DataFrame,
    targets: dict[str, dict[str, float]] = TARGETS,
    budget: float = BUDGET,
    seed: int = 5,
) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, weight, expected_copies, copies, probability, kept`` of each document."""
    spark = documents.sparkSession
    cells = cells_of(documents)
    table = spark.createDataFrame(
        mixing_table(cells, targets, budget),
        "source_group string, lang_group string, topic_group string, "
        "weight double, probability double, expected_copies double",
    )
    keyed = cells.withColumns({f"{name}_group": grouped(name, targets[name]) for name in DIMENSIONS})
    # One row per cell, bounded by the targets.
    found = keyed.join(F.broadcast(table), [f"{name}_group" for name in DIMENSIONS], "left")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return found.select(
        "doc_id",
        "source",
        "lang",
        "topic",
        "tokens",
        "weight",
        "expected_copies",
        drawn_copies(draw, F.col("expected_copies")).alias("copies"),
        "probability",
        (draw < F.col("probability")).alias("kept"),
    )


def mixed_documents(
    documents: DataFrame, targets=TARGETS, budget: float = BUDGET, seed: int = 5, repeats: bool = False
) -> DataFrame:
    """The rows of the documents that are drawn, with all their columns; with ``repeats``, each as often as its copies."""
    spark = documents.sparkSession
    mark = "mixing"
    while any(c.lower().startswith(mark) for c in documents.columns):
        mark += "_"
    *names, rate, number = (f"{mark} {name}" for name in (*DIMENSIONS, "rate", "copies"))
    table = spark.createDataFrame(
        [(*row[:3], row[5] if repeats else row[4]) for row in mixing_table(cells_of(documents), targets, budget)],
        ", ".join(f"`{name}` string" for name in names) + f", `{rate}` double",
    )

    def with_topic(batches):
        counter = TopicCounter()
        for batch in cut_by_bytes(batches, "text", 2 << 20):
            topics = counter.count(blobs(batch.column("text")))[1]
            yield batch.append_column(names[2], pa.array([str(t) for t in topics.tolist()], pa.string()))

    schema = T.StructType([*documents.schema.fields, T.StructField(names[2], T.StringType())])
    keyed = map_texts(documents, with_topic, schema).withColumns(
        {names[0]: grouped("source", targets["source"]), names[1]: grouped("lang", targets["lang"])}
    )
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # One row per cell, bounded by the targets.
    found = keyed.join(F.broadcast(table), names)
    if not repeats:
        return found.where(draw < column(rate)).select(*[column(c) for c in documents.columns])
    found = found.withColumn(number, drawn_copies(draw, column(rate))).where(column(number) > 0)
    found = found.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), column(number))))
    return found.select(*[column(c) for c in documents.columns])
