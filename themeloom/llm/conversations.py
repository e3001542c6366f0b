"""Conversations repaired to turns that alternate, by the cheapest edits, in linear space.

The rows of a conversation are read in the order of their turns (missing ones first), then
role, then the SHA-256 of the text. The first fault of a row counts: blank (only white
space), duplicate (role and text stood earlier in the conversation), truncated (the last
character that is no white space is none of ``.!?``). A repaired conversation is empty or reads, by
the first letters of its roles, ``s?(ua)+``. Keeping a row costs nothing, giving it the role user
or assistant 1, deleting it 2 (a must for blank and duplicate rows), inserting an empty row 5
anywhere, and each truncated row that stays 5 more. Among the cheapest audits (the letters
K, R, D, I in order) the least in ASCII is taken.

An audit is a path through four states: nothing yet, after the system's row, after the
user, after the assistant. Hirschberg's division finds it: the costs of reaching each
state from the start meet the costs of reaching the end in the middle, the crossing is
fixed, and both halves are divided again. The forward costs also carry the order of the
least audits to the four states, which no later edit can change, as none of them begins another; so of
the cheapest crossings the first one is right.

At scale the rows lie in ranges of their order, so a conversation of any length is spread out. Blocks of
neighbouring rows become a table of costs between states; one task meets the blocks of a
conversation in the middle by the same division, and then all blocks reconstruct their rows
apart. Only the final hash, which has to see the bytes in order, reads the texts of a conversation
one after another, and holds one at a time.

Nulls: a missing role, text, and part of the key of the damage count as one space; rows without
``conv_id`` are one conversation. Empty tables give no rows; conversations that lost all rows give zeros,
an empty audit and the hash of nothing. Repeated rows are duplicates. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from themeloom.llm.arrow import map_texts
from themeloom.tables import materialize

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

# Bits of a place within a block: 4096 rows. An audit is one cell, at most 2^31 letters, so a
# conversation has at most half a million blocks.
BLOCK_BITS = 12

# States: 0 nothing yet, 1 after the system's row, 2 after the user, 3 after the assistant.
ROLES = {2: "user", 3: "assistant"}
AFTER_ADDED = (2, 2, 3, 2)
# Classes of first letters, and where a kept row leads.
CLASSES = "uas"
AFTER_KEPT = {(0, 2): 1, (0, 0): 2, (1, 0): 2, (3, 0): 2, (2, 1): 3}
LEGAL = {(2, 0), (0, 1), (1, 0)}
TRUNCATED, BLANK, DUPLICATE = 1, 2, 3
INSERT, DELETE, REROLE, CUT_SHORT = 5, 2, 1, 5

# Ways through one row or block: (state before, state after, cost, what orders ways from one state).
Ways = Sequence[tuple[int, int, int, object]]


def _ways(code: int) -> Ways:
    """The cheapest, then least, letters that lead past a row, for each pair of states."""
    fault, letter = divmod(code, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state = start
        for added in range(3):
            steps = [(state, DELETE, "D")]
            if fault < BLANK:
                extra = CUT_SHORT * (fault == TRUNCATED)
                steps.append((AFTER_ADDED[state], REROLE + extra, "R"))
                if (state, letter) in AFTER_KEPT:
                    steps.append((AFTER_KEPT[state, letter], extra, "K"))
            for after, cost, edit in steps:
                way = (INSERT * added + cost, "I" * added + edit)
                best[start, after] = min(way, best.get((start, after), way))
            state = AFTER_ADDED[state]
    return [(*pair, *way) for pair, way in best.items()]


ROW_WAYS = [_ways(code) for code in range(16)]
END_WAYS: Ways = [(0, 3, 0, ""), (1, 3, 2 * INSERT, "II"), (2, 3, INSERT, "I"), (3, 3, 0, "")]
FAR = 1 << 60


def forward(items: Iterable[Ways], start: int) -> list[tuple[int, int]]:
    """For each state its cost from ``start`` and the rank of its least cheapest audit among the four."""
    reached = [(0, 0) if state == start else (FAR, 0) for state in range(4)]
    for ways in items:
        best: list = [None] * 4
        for before, after, cost, order in ways:
            far, rank = reached[before]
            if far < FAR:
                way = (far + cost, rank, order)
                if best[after] is None or way < best[after]:
                    best[after] = way
        ordered = sorted((way[1], way[2], state) for state, way in enumerate(best) if way)
        reached = [(FAR, 0)] * 4
        for rank, (_, _, state) in enumerate(ordered):
            reached[state] = (best[state][0], rank)
    return reached


def backward(items: Sequence[Ways], end: int) -> list[int]:
    """For each state the cost from it to ``end``."""
    left = [0 if state == end else FAR for state in range(4)]
    for ways in reversed(items):
        now = [FAR] * 4
        for before, after, cost, _ in ways:
            now[before] = min(now[before], cost + left[after])
        left = now
    return left


def crossings(items: Sequence[Ways], start: int, end: int) -> list[int]:
    """The states before, between and after the items on the least of the cheapest ways."""
    states = [start] + [0] * (len(items) - 1) + [end] if items else [start]
    parts = [(0, len(items))]
    while parts:
        low, high = parts.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        there = forward(items[low:middle], states[low])
        back = backward(items[middle:high], states[high])
        states[middle] = min(range(4), key=lambda s: (there[s][0] + back[s], there[s][1]))
        parts += [(low, middle), (middle, high)]
    return states


def _remembered(run):
    """``run`` with its answers about short conversations, which are often the same, kept per worker."""
    kept = functools.lru_cache(maxsize=10_000)(run)
    return functools.wraps(run)(lambda codes, *states: (kept if len(codes) <= 32 else run)(codes, *states))


@_remembered
def block_ways(codes: bytes) -> Ways:
    """A run of rows as one item: costs between states, and the order of ways from one state."""
    rows = [ROW_WAYS[code] for code in codes]
    ends = [forward(rows, start) for start in range(4)]
    return [(s, t, *ends[s][t]) for s in range(4) for t in range(4) if ends[s][t][0] < FAR]


@_remembered
def row_edits(codes: bytes, start: int, end: int) -> list[tuple[str, str, str | None]]:
    """Of each row: the roles inserted before it, its letter, and its new role if it gets one."""
    states = crossings([ROW_WAYS[code] for code in codes], start, end)
    edits = []
    for code, before, after in zip(codes, states, states[1:]):
        letters = next(order for s, t, _, order in ROW_WAYS[code] if (s, t) == (before, after))
        added, state = inserted(before, len(letters) - 1)
        edits.append((added, letters[-1], ROLES[AFTER_ADDED[state]] if letters[-1] == "R" else None))
    return edits


def inserted(state: int, count: int) -> tuple[str, int]:
    """First letters of the roles of ``count`` inserted rows, and the state they lead to."""
    letters = ""
    for _ in range(count):
        state = AFTER_ADDED[state]
        letters += ROLES[state][0]
    return letters, state


# --- rows ----------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut of their sentence ends, repeated or given to the user, by a hash of their key."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = conversations.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.withColumn("copy", F.explode("copies")).drop("copies", "copy")


ROW_KEYS = ("conv_id", "turn", "role", "digest", "row")


def _blocks(rows: DataFrame, rows_per_range: int) -> DataFrame:
    """Rows in their order, cut into blocks: arrays of their ids, keys, turns, classes and faults."""
    kept = F.rtrim(F.col("text"), F.lit(WHITE))
    whole = F.substring(kept, -1, 1).isin(".", "!", "?")
    letter = F.lit(len(CLASSES))
    for k, name in enumerate(CLASSES):
        letter = F.when(F.startswith("role", F.lit(name)), k).otherwise(letter)
    slim = rows.select(
        *ROW_KEYS,
        letter.alias("letter"),
        F.when(kept == "", BLANK).when(~whole, TRUNCATED).otherwise(0).alias("fault"),
    )
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_range))
    ordered = slim.repartitionByRange(ranges, *ROW_KEYS).sortWithinPartitions(*ROW_KEYS)
    # Written, so a place stays what it is when a task runs again.
    ordered = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "turns")
    firsts = ordered.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place"))
    # One row per place on both sides, so no key is hot.
    ordered = ordered.join(firsts.select("place", F.lit(True).alias("first")), "place", "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    row = F.struct("place", *ROW_KEYS, (F.col("letter") + 4 * fault).alias("code"))
    block = F.shiftright("place", BLOCK_BITS).alias("block")
    return materialize(ordered.groupBy(block).agg(F.sort_array(F.collect_list(row)).alias("rows")), "blocks")


def _segments(conv_ids: list) -> Iterator[tuple[int, int]]:
    """Runs of rows of one conversation."""
    start = 0
    for k in range(1, len(conv_ids) + 1):
        if k == len(conv_ids) or conv_ids[k] != conv_ids[start]:
            yield start, k
            start = k


SEGMENT = pa.schema([
    ("conv_id", pa.string()), ("block", pa.int64()), ("at", pa.int32()), ("ways", pa.list_(pa.int64())),
    ("faults", pa.list_(pa.int64())), ("illegal", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
    ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()),
])
MET = pa.schema([
    ("conv_id", pa.string()), ("block", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
    ("counts", pa.list_(pa.int64())), ("cost", pa.int64()), ("tail", pa.int32()),
])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of a conversation's rows in a block."""
    for batch in batches:
        out = []
        for block, conv_ids, turns, codes in zip(*(column.to_pylist() for column in batch.columns)):
            for low, high in _segments(conv_ids):
                run, known = codes[low:high], [t for t in turns[low:high] if t is not None]
                letters = [code % 4 for code in run]
                out.append({
                    "conv_id": conv_ids[low], "block": block, "at": low,
                    "ways": [x for way in block_ways(bytes(run)) for x in way],
                    "faults": [sum(code // 4 == fault for code in run) for fault in (BLANK, DUPLICATE, TRUNCATED)],
                    "illegal": sum(pair not in LEGAL for pair in zip(letters, letters[1:])),
                    "first": letters[0], "last": letters[-1],
                    "least": known[0] if known else None, "most": known[-1] if known else None, "turns": len(set(known)),
                })
        yield pa.RecordBatch.from_pylist(out, SEGMENT)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The segments of one conversation after the other, from rows sorted by it."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return (list(group) for _, group in itertools.groupby(rows, key=lambda row: row["conv_id"]))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the borders of a conversation's segments, and what is counted over all of them."""
    out: list[dict] = []
    for segments in _conversations(batches):
        items = [[tuple(x["ways"][k : k + 4]) for k in range(0, len(x["ways"]), 4)] for x in segments] + [END_WAYS]
        states = crossings(items, 0, 3)
        cost = sum(
            next(c for s, t, c, _ in ways if (s, t) == pair) for ways, pair in zip(items, zip(states, states[1:]))
        )
        illegal = sum(x["illegal"] for x in segments)
        illegal += sum((a["last"], b["first"]) not in LEGAL for a, b in zip(segments, segments[1:]))
        known = [x for x in segments if x["turns"]]
        turns = sum(x["turns"] for x in known) - sum(a["most"] == b["least"] for a, b in zip(known, known[1:]))
        gaps = known[-1]["most"] - known[0]["least"] + 1 - turns if known else 0
        faults = [sum(x["faults"][k] for x in segments) for k in range(3)]
        conv_id = segments[0]["conv_id"]
        for x, start, end in zip(segments, states, states[1:]):
            out.append({"conv_id": conv_id, "block": x["block"], "at": x["at"], "start": start, "end": end})
        out.append({"conv_id": conv_id, "counts": [gaps, *faults, illegal], "cost": cost, "tail": states[-2]})
        if len(out) >= 2_000:
            yield pa.RecordBatch.from_pylist(out, MET)
            out = []
    yield pa.RecordBatch.from_pylist(out, MET)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of all rows of a block, between the states at the borders of its segments."""
    for batch in batches:
        rows, borders, codes = (batch.column(name) for name in ("rows", "borders", "codes"))
        for k, (ends, run) in enumerate(zip(borders.to_pylist(), codes.to_pylist())):
            ends.sort(key=lambda x: x["at"])
            edits = []
            for x, upto in zip(ends, [*(y["at"] for y in ends[1:]), len(run)]):
                edits += row_edits(bytes(run[x["at"] : upto]), x["start"], x["end"])
            keys = rows[k].values
            columns = [keys.field(name) for name in ROW_KEYS]
            columns += [pa.array([edit[n] for edit in edits], pa.string()) for n in range(3)]
            yield pa.RecordBatch.from_arrays(columns, [*ROW_KEYS, "added", "edit", "new_role"])


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


REPAIRED = pa.schema([
    ("conv_id", pa.string()), *((name, pa.int64()) for name in RESULT), ("audit", pa.string()),
    ("repaired_sha256", pa.string()),
])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and hashes; the rows of a conversation pass one by one, each after its edit."""
    out, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == 0:
                if now:
                    out.append(now.done())
                now = _Repair(row["conv_id"])
            elif row["part"] == 1:
                now.numbers, now.tail = [*row["counts"], row["cost"]], row["tail"]
            elif row["part"] == 2:
                now.plan(row["added"], row["edit"], row["new_role"])
            else:
                now.take(row["role"], row["text"])
        yield pa.RecordBatch.from_pylist(out, REPAIRED)
        out = []
    if now:
        yield pa.RecordBatch.from_pylist([now.done()], REPAIRED)


class _Repair:
    """One conversation under repair: its audit and the running hash of its lines."""

    def __init__(self, conv_id):
        self.conv_id, self.numbers, self.tail = conv_id, [0] * len(RESULT), 0
        self.audit, self.sha, self.lines = [], hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.sha.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
        self.lines += 1

    def add(self, letters: str) -> None:
        for letter in letters:
            self.audit.append("I")
            self.line(next(role for role in ROLES.values() if role[0] == letter), "")

    def plan(self, added: str, edit: str, new_role: str | None) -> None:
        self.add(added)
        self.audit.append(edit)
        self.edit, self.new_role = edit, new_role

    def take(self, role: str, text: str) -> None:
        if self.edit != "D":
            self.line(self.new_role or role, text)

    def done(self) -> dict:
        if self.tail in (1, 2):
            self.add("ua" if self.tail == 1 else "a")
        texts = {"audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}
        return {"conv_id": self.conv_id, **dict(zip(RESULT, self.numbers)), **texts}


def repair(conversations: DataFrame, rows: DataFrame, rows_per_range: int = 500_000) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``.

    ``rows`` are what is repaired; every ``conv_id`` of ``conversations`` gets a result.
    """
    conv_id = F.col("conv_id").cast("string").alias("conv_id")
    digest = F.unhex(F.sha2(F.col("text"), 256)).alias("digest")
    rows = rows.select(conv_id, F.col("turn").cast("long").alias("turn"), "role", "text", digest)
    # Written with a number for each row, which tells equal rows apart when tasks run again.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    blocks = _blocks(rows, rows_per_range)

    part = lambda name: F.transform("rows", lambda x: x[name])
    codes = part("code").alias("codes")
    runs = blocks.select("block", part("conv_id").alias("conv_ids"), part("turn").alias("turns"), codes)
    segments = map_texts(runs, _summaries, from_arrow_schema(SEGMENT))
    # A task gets the segments of whole conversations, one for each 4096 rows.
    sorted_segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "block", "at")
    met = materialize(map_texts(sorted_segments, _meet, from_arrow_schema(MET)), "met")

    borders = met.where(F.col("block").isNotNull()).groupBy("block")
    borders = borders.agg(F.collect_list(F.struct("at", "start", "end")).alias("borders"))
    planned = blocks.join(borders, "block").select("rows", codes, "borders")
    keys = "conv_id string, turn long, role string, digest binary, row long"
    edits = map_texts(planned, _edit, f"{keys}, added string, edit string, new_role string")

    # One stream: a conversation's mark, its numbers, then each row's edit and text.
    stream = conversations.select(conv_id).distinct().withColumn("part", F.lit(0))
    numbers = met.where(F.col("block").isNull()).select("conv_id", "counts", "cost", "tail").withColumn("part", F.lit(1))
    for piece in (numbers, edits.withColumn("part", F.lit(2)), rows.withColumn("part", F.lit(3))):
        stream = stream.unionByName(piece, allowMissingColumns=True)
    # Marks and numbers have no role; rows always do.
    order = ["conv_id", F.col("role").isNotNull(), "turn", "role", "digest", "row", "part"]
    stream = stream.repartition("conv_id").sortWithinPartitions(*order)
    repaired = map_texts(stream, _assemble, from_arrow_schema(REPAIRED))
    return repaired.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))


def repair_damaged(conversations: DataFrame, **options: int) -> DataFrame:
    """``repair`` of the conversations with planted damage."""
    return repair(conversations, damaged(conversations), **options)
