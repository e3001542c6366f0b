"""Best-fit-decreasing packing into padded id matrices.

Documents become token ids closed by an end id; one longer than a window is split
losslessly into whole windows and a remainder. The remainders of a chunk are
placed longest first, each into the open window with the least room that still
holds it. A segment tree over the possible amounts of room finds that window in
logarithmic time. Windows with much room left are opened again for the next
chunk, ``HELD_WINDOWS`` of them at most, so padding stays small and a task holds a
chunk and a fixed number of windows.

Each row is one row of the matrix: ids padded to the window, the cumulative
lengths of its segments, positions that start anew with each segment, and the
documents the segments come from. ``write_matrix`` writes the rows as Parquet with
one fixed-size binary per row.

Null and empty texts give segments with the end id alone, repeated rows are packed
again, null ids are carried, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from themeloom.llm.arrow import binary_column, blobs, cut_by_bytes, map_texts
from themeloom.llm.packing import HELD_WINDOWS, SEQUENCES_PER_TASK, Piece
from themeloom.llm.tokens import END_ID, tokenizer_path, worker_encoder

SCHEMA = (
    "sequence_id long, n_tokens int, input_ids binary, position_ids binary, "
    "cu_seqlens array<int>, doc_ids array<long>, starts array<long>, doc_tokens array<long>"
)
ARROW_SCHEMA = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("input_ids", pa.binary()),
        ("position_ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
    ]
)


class RoomTree:
    """A segment tree over amounts of room: counts open windows, finds the least room that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: dict[int, list[list[Piece]]] = {}

    def add(self, room: int, window: list[Piece]) -> None:
        self.open.setdefault(room, []).append(window)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, list[Piece]] | None:
        """The open window with the least room of at least ``least``, no longer open."""
        tree, node = self.tree, self.leaves + least
        if not tree[node]:
            # Up to the first subtree of larger rooms that has a window, then down its left edge.
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(pieces: list[Piece], window: int) -> list[tuple[int, list[Piece]]]:
    """Windows as (room left, pieces)."""
    tree = RoomTree(window)
    for piece in sorted(pieces, key=lambda p: -len(p.ids)):
        room, members = tree.take(len(piece.ids)) or (window, [])
        members.append(piece)
        tree.add(room - len(piece.ids), members)
    return [(room, members) for room, windows in tree.open.items() for members in windows]


def _matrix_batch(rows: list[list[Piece]], first_id: int, window: int, pad_id: int) -> pa.RecordBatch:
    ids = np.full((len(rows), window), pad_id, dtype="<u4")
    positions = np.zeros((len(rows), window), dtype="<u4")
    ends = []
    for k, pieces in enumerate(rows):
        at, marks = 0, [0]
        for piece in pieces:
            n = len(piece.ids)
            ids[k, at : at + n] = piece.ids
            positions[k, at : at + n] = np.arange(n)
            at += n
            marks.append(at)
        ends.append(marks)
    sizes = np.full(len(rows), window)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(first_id + np.arange(len(rows))),
            pa.array([marks[-1] for marks in ends], pa.int32()),
            binary_column(ids.ravel(), sizes),
            binary_column(positions.ravel(), sizes),
            pa.array(ends, pa.list_(pa.int32())),
            pa.array([[p.doc_id for p in pieces] for pieces in rows], pa.list_(pa.int64())),
            pa.array([[p.start for p in pieces] for pieces in rows], pa.list_(pa.int64())),
            pa.array([[p.doc_tokens for p in pieces] for pieces in rows], pa.list_(pa.int64())),
        ],
        schema=ARROW_SCHEMA,
    )


def _matrix_task(
    batches: Iterable[pa.RecordBatch], path: str, end_id: int, pad_id: int, window: int, chunk_bytes: int
) -> Iterator[pa.RecordBatch]:
    words = worker_encoder(path)
    context = TaskContext.get()
    next_id = (context.partitionId() if context else 0) * SEQUENCES_PER_TASK
    again: list[Piece] = []

    def written(rows: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
        nonlocal next_id
        for first in range(0, len(rows), 256):
            some = rows[first : first + 256]
            yield _matrix_batch(some, next_id, window, pad_id)
            next_id += len(some)

    for batch in cut_by_bytes(batches, "text", chunk_bytes):
        ids, begins = words.encode(blobs(batch.column("text")), end_id)
        whole: list[list[Piece]] = []
        for doc_id, begin, end in zip(batch.column("doc_id").to_pylist(), begins.tolist(), begins[1:].tolist()):
            for at in range(begin, end, window):
                piece = Piece(doc_id, at - begin, end - begin, ids[at : min(at + window, end)])
                if len(piece.ids) == window:
                    whole.append([piece])
                else:
                    again.append(piece)
        windows = best_fit_decreasing(again, window)
        loose = window // 64
        yield from written(whole)
        # The fullest are written, also of those with room, where more than a fixed number would wait.
        windows.sort(key=lambda w: w[0])
        full = max(sum(room < loose for room, _ in windows), len(windows) - HELD_WINDOWS)
        yield from written([pieces for _, pieces in windows[:full]])
        again = [p._replace(ids=p.ids.copy()) for _, pieces in windows[full:] for p in pieces]
    yield from written([pieces for _, pieces in best_fit_decreasing(again, window)])


def pack_matrix(
    documents: DataFrame,
    path: str | None = None,
    end_id: int = END_ID,
    pad_id: int = 0,
    window: int = 4096,
    chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per sequence; ids and positions are little-endian unsigned 32-bit."""
    path = path or tokenizer_path()

    def run(batches):
        return _matrix_task(batches, path, end_id, pad_id, window, chunk_bytes)

    return map_texts(documents.select("doc_id", "text"), run, SCHEMA, keeps=(path,))


def write_matrix(rows: DataFrame, folder: str) -> None:
    """The rows as Parquet files, one fixed-size binary of ids and one of positions per row."""
    rows.write.mode("errorifexists").parquet(folder)
