"""Packing by minimum bin slack.

Every document becomes token ids closed by an end id. Whole windows are cut off
long documents; what remains of each is shorter than a window. For each window
the longest waiting remainder is taken, and a bitset subset-sum over the other
remaining lengths (bounded counts, split into powers of two) finds the multiset
that fills the window closest to its capacity; the counts are read back from the
stored bitsets. Windows that can be filled exactly are written. The others wait
for the next chunk of documents, up to ``HELD_WINDOWS`` windows of ids; what waits beyond
that is cut into whole windows, and what is left at the end of a task also into
sequences whose lengths are powers of two.

A task packs its own documents, in chunks of bounded size and with a bounded
rest, so nothing is shuffled and a lost task is simply done again.

Null and empty texts are documents with the end id alone. Rows that repeat are
packed again. Rows with a null ``doc_id`` are packed too and carry the null.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from themeloom.llm.arrow import binary_column, blobs, cut_by_bytes, map_texts
from themeloom.llm.tokens import END_ID, tokenizer_path, worker_encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

# A task numbers its sequences from its own multiple of this.
SEQUENCES_PER_TASK = 1 << 36

# Windows of ids that may wait for a better fill, 4 MB at 4096 ids each.
HELD_WINDOWS = 256


class Piece(NamedTuple):
    """A run of one document's ids, not yet placed."""

    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is closest to ``room`` from below."""
    reach, within = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= reach << length * part & within
            left -= part
            part *= 2
    total, taken = reach.bit_length() - 1, {}
    for before, length, part in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + part
            total -= length * part
    return taken


def fill_windows(waiting: dict[int, list[Piece]], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows filled exactly, and the pieces that found no such window."""
    counts = {length: len(pieces) for length, pieces in waiting.items() if pieces}
    lengths = sorted(counts)
    total = sum(length * n for length, n in counts.items())
    filled: list[list[Piece]] = []
    rest: list[Piece] = []

    def take(length: int) -> Piece:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return waiting[length].pop()

    while lengths:
        longest = lengths[-1]
        if longest not in counts:
            lengths.pop()
            continue
        if total < window:
            rest += [take(length) for length in list(counts) for _ in range(counts[length])]
            break
        one = take(longest)
        total -= longest
        chosen = closest_fill(counts, window - longest)
        if longest + sum(length * n for length, n in chosen.items()) == window:
            filled.append([one, *(take(length) for length, n in chosen.items() for _ in range(n))])
            total -= window - longest
        else:
            rest.append(one)
    return filled, rest


def cut_pieces(rest: list[Piece], sizes: list[int]) -> tuple[list[list[Piece]], list[Piece]]:
    """The pieces one after another, cut into sequences of these sizes; and the pieces behind them."""
    sequences, pieces = [], iter(rest)
    piece = next(pieces, None)
    for size in sizes:
        sequence, room = [], size
        while room:
            head = piece._replace(ids=piece.ids[:room])
            sequence.append(head)
            room -= len(head.ids)
            tail = piece.ids[len(head.ids) :]
            piece = (
                piece._replace(start=piece.start + len(head.ids), ids=tail) if len(tail) else next(pieces, None)
            )
        sequences.append(sequence)
    return sequences, [piece, *pieces] if piece else []


def cut_rest(rest: list[Piece], window: int) -> list[list[Piece]]:
    """The pieces one after another, cut at every window and then at powers of two."""
    left = sum(len(piece.ids) for piece in rest)
    sizes = [window] * (left // window)
    sizes += [1 << bit for bit in reversed(range(window.bit_length())) if left % window >> bit & 1]
    return cut_pieces(rest, sizes)[0]


def sequence_batch(sequences: list[list[Piece]], first_id: int, schema: pa.Schema) -> pa.RecordBatch:
    pieces = [piece for sequence in sequences for piece in sequence]
    lengths = np.fromiter((len(piece.ids) for piece in pieces), dtype=np.int64, count=len(pieces))
    per_sequence = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    begins = np.cumsum(lengths) - lengths
    firsts = np.cumsum(per_sequence) - per_sequence
    return pa.RecordBatch.from_arrays(
        [
            pa.array([piece.doc_id for piece in pieces], pa.int64()),
            pa.array([piece.start for piece in pieces], pa.int64()),
            pa.array(lengths),
            pa.array([piece.doc_tokens for piece in pieces], pa.int64()),
            pa.array(np.repeat(first_id + np.arange(len(sequences)), per_sequence)),
            pa.array(begins - np.repeat(begins[firsts], per_sequence)),
            binary_column(np.concatenate([piece.ids for piece in pieces]).astype("<u4"), lengths),
        ],
        schema=schema,
    )


ARROW_SCHEMA = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary())]
)


def _pack_task(
    batches: Iterable[pa.RecordBatch], path: str, end_id: int, window: int, chunk_bytes: int
) -> Iterator[pa.RecordBatch]:
    words = worker_encoder(path)
    context = TaskContext.get()
    next_id = (context.partitionId() if context else 0) * SEQUENCES_PER_TASK
    rest: list[Piece] = []

    def written(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
        nonlocal next_id
        for first in range(0, len(sequences), 256):
            some = sequences[first : first + 256]
            yield sequence_batch(some, next_id, ARROW_SCHEMA)
            next_id += len(some)

    for batch in cut_by_bytes(batches, "text", chunk_bytes):
        ids, begins = words.encode(blobs(batch.column("text")), end_id)
        whole: list[list[Piece]] = []
        waiting: dict[int, list[Piece]] = {}
        for piece in rest:
            waiting.setdefault(len(piece.ids), []).append(piece)
        for doc_id, begin, end in zip(batch.column("doc_id").to_pylist(), begins.tolist(), begins[1:].tolist()):
            n = end - begin
            for start in range(0, n - window + 1, window):
                at = begin + start
                whole.append([Piece(doc_id, start, n, ids[at : at + window])])
            if n % window:
                start = n - n % window
                waiting.setdefault(n % window, []).append(Piece(doc_id, start, n, ids[begin + start : end]))
        filled, rest = fill_windows(waiting, window)
        yield from written(whole)
        yield from written(filled)
        beyond = sum(len(piece.ids) for piece in rest) // window - HELD_WINDOWS
        cut, rest = cut_pieces(rest, [window] * max(0, beyond))
        yield from written(cut)
        rest = [piece._replace(ids=piece.ids.copy()) for piece in rest]
    yield from written(cut_rest(rest, window))


def pack_documents(
    documents: DataFrame,
    path: str | None = None,
    end_id: int = END_ID,
    window: int = 4096,
    chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per piece of a document, with its ids (little-endian unsigned 32-bit) and its place.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's.
    All sequences are ``window`` long but at most a few per task, whose lengths are
    powers of two. ``window`` must be a power of two itself.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    path = path or tokenizer_path()

    def run(batches):
        return _pack_task(batches, path, end_id, window, chunk_bytes)

    return map_texts(documents.select("doc_id", "text"), run, SCHEMA, keeps=(path,))
