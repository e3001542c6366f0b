"""Repeated byte strings across documents, by prefix doubling over a shrinking set of positions.

A position's *name* at length ``h`` stands for the ``h`` bytes that start there, as a
rank does in prefix doubling, but is a 64-bit fingerprint, so any task can make it
from the text it holds. Rounds sort names at growing offsets and go on with those
positions only that are not unique yet:

1. ``h = ceil(T / 2)``. Every string of ``T`` bytes is represented by the least name
   within it, which equal strings share; a run of neighbours mostly has the same
   one. Names found in one document only make all their strings unique.
2. Runs of strings with a shared name, by (name, name of all bytes of the run). A
   run that an earlier document also has is repeated as a whole. If all runs of a
   name are equal, nothing is left to ask.
3. The remaining strings themselves, by the pair (name at the position, name ``T - h``
   bytes on): doubling the length, which is the threshold, so this is the last round.

Positions travel as packed arrays: the documents are gathered once into blocks of
compressed text in a table bucketed by block; a round sends, from each block to
each of many key ranges, the sorted distinct keys with the earliest document of
each, and gets bits back. A key therefore arrives at most once per block however often
it is repeated, and the text is not shuffled again.

Texts are UTF-8 bytes, null is empty, matches never cross documents. A string is
removed where a document with a smaller ``doc_id`` has it too, judged on the input.
Rows without ``doc_id`` lose nothing and remove nothing; rows with one ``doc_id`` do
not remove each other's strings. Every row is returned; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.arrow import blobs, held, map_texts
from themeloom.llm.minhash import mixed
from themeloom.tables import column, materialize, quoted, scratch_path

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 60_000  # documents of a block are numbered in 16 bits
SLICE_BYTES = (1 << 20) - 4096
RANGE_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
RANGES_PER_TASK = 8

BLOCK_SCHEMA = "block string, n_bytes long, doc_ids binary, known binary, sizes binary, data binary, others binary"
KEY_SCHEMA = "part int, block string, keys binary, docs binary, which binary"
REPLY_SCHEMA = "block string, part int, bits binary"

_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(20260102).integers(0, 2**64, 256, dtype=np.uint64)


POWERS = "powers"
KEEPS = (POWERS,)
SLICE_ROOM = 1 << 20  # a slice and the rest of its last string


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, inverse, np.uint64))


class Names:
    """Fingerprints of any stretch of a buffer in constant time."""

    def __init__(self, data: np.ndarray):
        n = 1 << (len(data) - 1).bit_length()
        up, self.down = _powers(n) if n > SLICE_ROOM else held(POWERS, lambda: _powers(SLICE_ROOM))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[data] * up[: len(data)], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


class Block(NamedTuple):
    doc_ids: np.ndarray
    known: np.ndarray
    sizes: np.ndarray
    data: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        data = zstandard.ZstdDecompressor().decompress(row["data"])
        return cls(
            np.frombuffer(row["doc_ids"], "<i8"),
            np.frombuffer(row["known"], bool),
            np.frombuffer(row["sizes"], "<i8"),
            np.frombuffer(data, np.uint8),
        )


class Runs(NamedTuple):
    """Runs of strings with the same least name; ``first`` and ``last`` are starts of strings in the block."""

    name: np.ndarray
    whole: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray


def slices(block: Block, threshold: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of the block: where it starts, its bytes, and the first and past-last string of each document."""
    ends = np.cumsum(block.sizes)
    starts = ends - block.sizes
    total = len(block.data)
    for at in range(0, total, SLICE_BYTES):
        upto = min(at + SLICE_BYTES, total)
        stop = min(upto + threshold - 1, total)
        low = np.clip(starts, at, upto) - at
        high = np.clip(np.minimum(ends - threshold + 1, upto), at, upto) - at
        keep = (high > low) & block.known
        yield at, block.data[at:stop], np.where(keep, low, 0), np.where(keep, high, 0)


def runs_of(block: Block, threshold: int) -> Runs:
    half = -(-threshold // 2)
    found = []
    for at, data, low, high in slices(block, threshold):
        counts = high - low
        if not counts.any():
            continue
        names = Names(data)
        least = sliding_least(names.all(half), threshold - half + 1)
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(int(counts.sum())) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        name = least[place]
        begins = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]))
        lasts = np.append(begins[1:], len(name)) - 1
        first, last = place[begins], place[lasts]
        whole = names.at(first, last + threshold) + (last - first).astype(np.uint64)
        # Least names crowd at the low end; scrambled one to one they fill the key ranges evenly.
        found.append((mixed(name[begins]), whole, first + at, last + at, doc[begins]))
    if not found:
        return Runs(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)))
    return Runs(*map(np.concatenate, zip(*found)))


class Entries(NamedTuple):
    """Distinct keys of a block in order, the earliest document of each, and each occurrence's key."""

    keys: np.ndarray  # two columns
    least: np.ndarray  # rank of the document within the block
    key_of: np.ndarray


def entries_of(first: np.ndarray, second: np.ndarray, rank: np.ndarray) -> Entries:
    order = np.lexsort((rank, second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    key_of = np.empty(len(a), dtype=np.int64)
    key_of[order] = np.cumsum(new) - 1
    return Entries(np.stack([a[new], b[new]], axis=1), rank[order][new], key_of)


def ranks_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a block in order, and each document's place among them."""
    ids, rank = np.unique(block.doc_ids, return_inverse=True)
    return ids, rank.reshape(-1)


def by_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each range of keys begins; keys are sorted."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


# --- keys as bytes -------------------------------------------------------------------------------


def packed(keys: np.ndarray, widths: tuple[int, int]) -> bytes:
    """The leading bytes of each of the two columns, row by row."""
    columns = [keys[:, c].astype(">u8").view(np.uint8).reshape(-1, 8)[:, : widths[c]] for c in (0, 1)]
    return np.ascontiguousarray(np.concatenate(columns, axis=1)).tobytes()


def unpacked(data: bytes, widths: tuple[int, int]) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, sum(widths))
    out = np.zeros((len(rows), 2, 8), dtype=np.uint8)
    out[:, 0, : widths[0]] = rows[:, : widths[0]]
    out[:, 1, : widths[1]] = rows[:, widths[0] :]
    return out.view(">u8")[..., 0].astype(np.uint64)


# Bytes sent of the two columns of a key in each round. The first only sorts out, so
# names that agree by chance do no harm there.
WIDTHS = {"names": (6, 0), "runs": (8, 8), "strings": (8, 6)}


def _sent(block_id: str, block: Block, entries: Entries, parts: int, widths: tuple[int, int]) -> pa.RecordBatch | None:
    ids, _ = ranks_of(block)
    cuts = by_part(entries.keys[:, 0], parts)
    rows = []
    for part, (a, b) in enumerate(itertools.pairwise(cuts.tolist())):
        if a < b:
            ranks, which = np.unique(entries.least[a:b], return_inverse=True)
            rows.append(
                (
                    part,
                    block_id,
                    packed(entries.keys[a:b], widths),
                    ids[ranks].astype("<i8").tobytes(),
                    which.reshape(-1).astype("<u2").tobytes(),
                )
            )
    if not rows:
        return None
    types = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
    names = ("part", "block", "keys", "docs", "which")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))


# --- what each range of keys answers ---------------------------------------------------------------


def _segments(new: np.ndarray, reduce: np.ufunc, values: np.ndarray) -> np.ndarray:
    """The reduction of each run that starts at ``new``, spread over its rows."""
    return reduce.reduceat(values, np.flatnonzero(new))[np.cumsum(new) - 1]


def _judge(kind: str, keys: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """Bits for each row of keys and documents, in the order given."""
    order = np.lexsort((docs, keys[:, 1], keys[:, 0]))
    a, b, d = keys[order, 0], keys[order, 1], docs[order]
    new_name = np.ones(len(a), dtype=bool)
    new_name[1:] = a[1:] != a[:-1]
    new_key = new_name.copy()
    new_key[1:] |= b[1:] != b[:-1]
    if kind == "names":
        found = [_segments(new_name, np.minimum, d) != _segments(new_name, np.maximum, d)]
    else:
        earlier = _segments(new_key, np.minimum, d) < d
        found = [earlier]
        if kind == "runs":
            differ = _segments(new_name, np.minimum, b) != _segments(new_name, np.maximum, b)
            found.append(differ & ~earlier)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return [bits[back] for bits in found]


def _judge_task(batches: Iterable[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Replies of each range of keys; the rows of a range come one after another."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(name) for name in ("part", "block", "keys", "docs", "which")]
            yield from zip(columns[0].to_pylist(), columns[1].to_pylist(), *map(blobs, columns[2:]))

    for part, group in itertools.groupby(rows(), key=lambda row: row[0]):
        blocks, keys, docs = [], [], []
        for _, block, key, ids, which in group:
            blocks.append(block)
            keys.append(unpacked(key, WIDTHS[kind]))
            docs.append(np.frombuffer(ids, "<i8")[np.frombuffer(which, "<u2")])
        sizes = np.cumsum([len(d) for d in docs])[:-1]
        found = [np.split(bits, sizes) for bits in _judge(kind, np.concatenate(keys), np.concatenate(docs))]
        replies = [np.packbits(np.concatenate(bits)).tobytes() for bits in zip(*found)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blocks, pa.string()),
                pa.array([part] * len(blocks), pa.int32()),
                pa.array(replies, pa.binary()),
            ],
            ["block", "part", "bits"],
        )


def _answers(reply: list[dict], entries: Entries, parts: int, n_bits: int) -> list[np.ndarray]:
    """The bits of a block's keys, in their order, from the replies of all ranges."""
    out = [np.zeros(len(entries.keys), dtype=bool) for _ in range(n_bits)]
    cuts = by_part(entries.keys[:, 0], parts)
    for one in reply:
        a, b = cuts[one["part"]], cuts[one["part"] + 1]
        bits = np.unpackbits(np.frombuffer(one["bits"], np.uint8)).astype(bool)
        for k in range(n_bits):
            out[k][a:b] = bits[k * (b - a) : (k + 1) * (b - a)]
    return out


# --- rounds, seen from a block ----------------------------------------------------------------------


class Rounds:
    """What a block knows after each round; every task works it out anew from its text and the replies."""

    def __init__(self, block: Block, threshold: int, parts: int):
        self.block, self.threshold, self.parts = block, threshold, parts
        self.rank = ranks_of(block)[1]
        self.runs = runs_of(block, threshold)

    def names(self) -> Entries:
        """Names, each twice if two documents of the block have it, so that it counts as shared."""
        rank = self.rank[self.runs.doc]
        return entries_of(self.runs.name, self._is_second(rank), rank)

    def _is_second(self, rank: np.ndarray) -> np.ndarray:
        order = np.lexsort((rank, self.runs.name))
        name, r = self.runs.name[order], rank[order]
        new = np.ones(len(name), dtype=bool)
        new[1:] = name[1:] != name[:-1]
        second = np.empty(len(name), dtype=np.uint64)
        second[order] = (_segments(new, np.minimum, r) < r) if len(name) else 0
        return second

    def shared_runs(self, reply: list[dict]) -> tuple[np.ndarray, Entries]:
        entries = self.names()
        (shared,) = _answers(reply, entries, self.parts, 1)
        places = np.flatnonzero(shared[entries.key_of])
        return places, entries_of(self.runs.name[places], self.runs.whole[places], self.rank[self.runs.doc[places]])

    def after_runs(self, names: list[dict], runs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Runs repeated as a whole, and runs whose strings are still in question."""
        places, entries = self.shared_runs(names)
        earlier, asked = _answers(runs, entries, self.parts, 2)
        repeated = earlier[entries.key_of] | (self.rank[self.runs.doc[places]] > entries.least[entries.key_of])
        return places[repeated], places[~repeated & asked[entries.key_of]]

    def strings(self, asked: np.ndarray) -> tuple[np.ndarray, Entries]:
        """Starts of the strings in question and their keys."""
        first, last = self.runs.first[asked], self.runs.last[asked]
        counts = last - first + 1
        starts = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
        rank = np.repeat(self.rank[self.runs.doc[asked]], counts)
        half = -(-self.threshold // 2)
        pair = np.zeros((2, len(starts)), dtype=np.uint64)
        for at, data, _, _ in slices(self.block, self.threshold):
            a, b = np.searchsorted(starts, [at, at + SLICE_BYTES])
            if a < b:
                names, here = Names(data), starts[a:b] - at
                pair[0, a:b] = names.at(here, here + half)
                pair[1, a:b] = names.at(here + self.threshold - half, here + self.threshold)
        return starts, entries_of(pair[0], pair[1], rank)

    def removed(self, names: list[dict], runs: list[dict], strings: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Maximal stretches of the block to remove, as starts and ends."""
        repeated, asked = self.after_runs(names, runs)
        starts, entries = self.strings(asked)
        (earlier,) = _answers(strings, entries, self.parts, 1)
        counts = self.runs.last[asked] - self.runs.first[asked] + 1
        rank = np.repeat(self.rank[self.runs.doc[asked]], counts)
        hit = starts[earlier[entries.key_of] | (rank > entries.least[entries.key_of])]
        begin = np.concatenate([self.runs.first[repeated], hit])
        end = np.concatenate([self.runs.last[repeated], hit]) + self.threshold
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        ends = np.cumsum(self.block.sizes)
        doc = np.searchsorted(ends, begin, side="right")
        reach = np.maximum.accumulate(end) if len(end) else end
        new = np.ones(len(begin), dtype=bool)
        new[1:] = (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
        last = np.append(np.flatnonzero(new)[1:], len(begin)) - 1
        return begin[new], reach[last] if len(begin) else reach


def _block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _to_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in blocks; columns other than id and text go along as they are."""
    context = TaskContext.get()
    task, count = context.partitionId() if context else 0, 0
    ids: list[int | None] = []
    texts: list[bytes] = []
    others: list[pa.RecordBatch] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        nonlocal count, size
        compress = zstandard.ZstdCompressor(level=5).compress
        row = {
            "block": f"{task}-{count}",
            "n_bytes": size,
            "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(),
            "known": np.array([i is not None for i in ids], bool).tobytes(),
            "sizes": np.array([len(t) for t in texts], "<i8").tobytes(),
            "data": compress(b"".join(texts)),
            "others": None,
        }
        if others:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, others[0].schema) as stream:
                for batch in others:
                    stream.write_batch(batch)
            row["others"] = compress(sink.getvalue().to_pybytes())
        types = (pa.string(), pa.int64(), *[pa.binary()] * 5)
        count, size = count + 1, 0
        for held in (ids, texts, others):
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

    for batch in batches:
        rest = batch.select([name for name in batch.schema.names if name not in ("repeat_id", "repeat_text")])
        first = 0
        pairs = zip(batch.column("repeat_id").to_pylist(), blobs(batch.column("repeat_text")))
        for k, (doc_id, text) in enumerate(pairs):
            text = text or b""
            if texts and (size + len(text) > BLOCK_BYTES or len(texts) == BLOCK_ROWS):
                if rest.num_columns and k > first:
                    others.append(rest.slice(first, k - first))
                first = k
                yield flushed()
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
        if rest.num_columns and batch.num_rows > first:
            others.append(rest.slice(first))
    if texts:
        yield flushed()


def _bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """Blocks written once, so that later joins by block leave them where they are."""
    spark = blocks.sparkSession
    name = f"themeloom_blocks_{uuid.uuid4().hex}"
    writer = blocks.repartition(buckets, "block").write.bucketBy(buckets, "block").format("parquet")
    writer.option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def _with_replies(blocks: DataFrame, replies: dict[str, DataFrame]) -> DataFrame:
    for kind, reply in replies.items():
        gathered = reply.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias(kind))
        blocks = blocks.join(gathered, "block", "left")
    return blocks


def _round(blocks: DataFrame, kind: str, keys_of: Callable[[Rounds, dict], Entries], threshold: int, parts: int):
    """One round: keys of all blocks, sorted and judged by range, as replies written to the shared folder."""
    def send(batches):
        for row in _block_rows(batches):
            rounds = Rounds(Block.read(row), threshold, parts)
            batch = _sent(row["block"], rounds.block, keys_of(rounds, row), parts, WIDTHS[kind])
            if batch is not None:
                yield batch

    def judge(batches):
        return _judge_task(batches, kind)

    sent = map_texts(blocks, send, KEY_SCHEMA, KEEPS)
    spark = blocks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(parts / RANGES_PER_TASK))
    ranges = sent.repartition(tasks, "part").sortWithinPartitions("part")
    return materialize(map_texts(ranges, judge, REPLY_SCHEMA), kind)


class Repeats(NamedTuple):
    """The blocks with all replies, ready to be cut."""

    rows: DataFrame
    threshold: int
    parts: int


def find_repeats(documents: DataFrame, threshold: int = 50, others: list[str] | None = None) -> Repeats:
    """The documents in blocks with the replies of all rounds; columns ``others`` are carried along."""
    if threshold < 2:
        raise ValueError("threshold must be at least 2")
    spark = documents.sparkSession
    source = documents.select(
        F.col("doc_id").cast("long").alias("repeat_id"),
        F.col("text").alias("repeat_text"),
        *[column(name) for name in others or []],
    )
    total = source.agg(F.coalesce(F.sum(F.octet_length("repeat_text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / RANGE_BYTES))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_BYTES))
    blocks = _bucketed(map_texts(source, _to_blocks, BLOCK_SCHEMA), buckets)
    replies: dict[str, DataFrame] = {}
    steps: list[tuple[str, Callable[[Rounds, dict], Entries]]] = [
        ("names", lambda rounds, row: rounds.names()),
        ("runs", lambda rounds, row: rounds.shared_runs(row["names"] or [])[1]),
        (
            "strings",
            lambda rounds, row: rounds.strings(rounds.after_runs(row["names"] or [], row["runs"] or [])[1])[1],
        ),
    ]
    for kind, keys_of in steps:
        replies[kind] = _round(_with_replies(blocks, replies), kind, keys_of, threshold, parts)
    return Repeats(_with_replies(blocks, replies), threshold, parts)


class Cut(NamedTuple):
    """A document's removed spans, as byte offsets, and the bytes that are left."""

    spans: list[tuple[int, int]]
    kept: bytes


def _cuts(row: dict, threshold: int, parts: int) -> tuple[Block, list[Cut]]:
    block = Block.read(row)
    replies = [row[kind] or [] for kind in ("names", "runs", "strings")]
    begin, end = Rounds(block, threshold, parts).removed(*replies)
    ends = np.cumsum(block.sizes)
    starts = ends - block.sizes
    data, cuts = block.data.tobytes(), []
    for s, e, a, b in zip(
        starts.tolist(), ends.tolist(), np.searchsorted(begin, starts).tolist(), np.searchsorted(begin, ends).tolist()
    ):
        spans = list(zip(begin[a:b].tolist(), end[a:b].tolist()))
        edges = [s, *itertools.chain.from_iterable(spans), e]
        kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
        cuts.append(Cut([(x - s, y - s) for x, y in spans], kept))
    return block, cuts


CUT_SCHEMA = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"
)


def remove_repeats(documents: DataFrame, threshold: int = 50) -> DataFrame:
    """Per row: ``doc_id``, sizes, the bytes kept, and the removed spans as byte offsets."""
    repeats = find_repeats(documents, threshold)
    parts = repeats.parts
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for row in _block_rows(batches):
            block, cuts = _cuts(row, threshold, parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.doc_ids, mask=~block.known),
                    pa.array(block.sizes),
                    pa.array([sum(y - x for x, y in one.spans) for one in cuts], pa.int64()),
                    pa.array([len(one.spans) for one in cuts], pa.int64()),
                    pa.array([one.kept for one in cuts], pa.binary()),
                    pa.array([[{"start": x, "end": y} for x, y in one.spans] for one in cuts], span_type),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    return map_texts(repeats.rows, cut, CUT_SCHEMA, KEEPS)


def documents_without_repeats(documents: DataFrame, threshold: int = 50) -> DataFrame:
    """The documents with their columns, the removed bytes cut out of ``text`` and ``n_chars`` counted anew.

    A character cut in two is dropped. Texts without a removed byte, null ones among
    them, and rows of any kind stay as they are.
    """
    names = documents.columns
    others = [name for name in names if name not in ("doc_id", "text")]
    # Nulls are told from empty texts by a flag, as blocks hold bytes only.
    flagged = documents.withColumn("repeat null", F.col("text").isNull())
    repeats = find_repeats(flagged, threshold, [*others, "repeat null"])
    parts, schema = repeats.parts, documents.schema
    id_type = schema["doc_id"].dataType

    def cut(batches):
        for row in _block_rows(batches):
            block, cuts = _cuts(row, threshold, parts)
            data = zstandard.ZstdDecompressor().decompress(row["others"])
            rest = pa.ipc.open_stream(data).read_all().combine_chunks()
            nulls = rest.column("repeat null").to_pylist()
            texts = [None if null else one.kept.decode(errors="ignore") for one, null in zip(cuts, nulls)]
            columns = {name: rest.column(name) for name in others}
            columns["doc_id"] = pa.array(block.doc_ids, mask=~block.known)
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                new = [len(t) if one.spans else n for t, one, n in zip(texts, cuts, old)]
                columns["n_chars"] = pa.array(new, columns["n_chars"].type)
            table = pa.table([columns[name] for name in names], names=names)
            yield from table.to_batches()

    out = documents.select(
        *[F.col("doc_id").cast("long").alias("doc_id") if name == "doc_id" else column(name) for name in names]
    ).schema
    found = map_texts(repeats.rows, cut, out, KEEPS)
    return found.select(*[found[quoted(n)].cast(id_type).alias(n) if n == "doc_id" else column(n) for n in names])
