"""Arrow helpers inside tasks: texts as bytes, batches cut by bytes, binary columns from arrays."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Rows and bytes of one Arrow batch. Spark's defaults of 10,000 rows and 64 MB are held
# several times over in each running task.
BATCH_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216b",
}


# Parameters of the C library's ``mallopt``.
_MMAP_THRESHOLD, _ARENA_MAX = -3, -8


@functools.lru_cache(maxsize=1)
def _settle() -> None:
    """Large arrays of this Python worker go back to the system when they are freed, not when the worker ends.

    Left alone, the C library raises its threshold to what was freed last and keeps such
    arrays in its heap, and Arrow's own pool keeps what it had at its peak.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option:
        set_option(_MMAP_THRESHOLD, 1 << 20)
        set_option(_ARENA_MAX, 2)


def _give_back() -> None:
    """Return freed memory to the system; a Python worker serves many tasks of many operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_HELD: dict = {}


def held(name, make):
    """What a Python worker keeps from one task to the next of the same operator, made when it is first asked for."""
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def _let_go(keeps) -> None:
    others = [name for name in _HELD if name not in keeps]
    for name in others:
        del _HELD[name]
    if others:
        _give_back()


def map_texts(rows: DataFrame, task, schema, keeps=()) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts; the session keeps these settings.

    Whatever a worker holds under names other than ``keeps`` it lets go first, so that a
    worker never carries the tables of several operators.
    """
    for name, limit in BATCH_LIMITS.items():
        rows.sparkSession.conf.set(name, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _settle()
        _let_go(keeps)
        try:
            yield from task(batches)
        finally:
            _give_back()

    return rows.mapInArrow(run, schema)


def blobs(column: pa.Array) -> list[bytes | None]:
    """A string or binary column as bytes objects, without decoding."""
    return (column.cast(pa.binary()) if pa.types.is_string(column.type) else column).to_pylist()


def cut_by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes in ``column``; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def binary_column(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column whose rows are consecutive runs of ``flat``, ``lengths`` items each."""
    flat = np.ascontiguousarray(flat)
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(np.asarray(lengths, dtype=np.int64) * flat.itemsize, out=offsets[1:])
    if offsets[-1] >= 2**31:
        raise ValueError("a batch of one binary column is limited to 2 GB")
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)]
    )
