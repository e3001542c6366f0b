"""CSV files cut into records by many tasks each, whatever their quoted cells hold.

A line break ends a record unless it stands in a quoted cell, and a cell is quoted if a quote opens
it. Spark's text source deals a file out in blocks of bytes, so the task of a block does not
know whether the block starts inside a cell. But a line either leaves that as it is, turns it over,
or settles it, and the same holds for a block: a first scan reduces each block to
what it does from either start, and the blocks before a block tell how it starts. A
second scan then knows where every record ends. A record that runs over the end of its
block leaves fragments, which are joined by the block in which the record began.

The first scan also tells the encoding and the first record of each file, so one second scan reads files of any
mix of encodings and headers, each by its own. Files in UTF-16, whose line ends are no
single bytes, and files with carriage returns for line ends are left to Spark's own reader, a
file a task.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.sources.encodings import UTF_8, UTF_16, UTF_16_MARKS, WESTERN, repaired, spark_charset
from themeloom.tables import materialize

# Files or blocks up to this number are broadcast, at about 100 bytes each; a longer list is
# joined by shuffle. A block is 128 MB of input unless the session says otherwise.
BROADCAST_ROWS = 200_000

# A quoted cell with what may follow its closing quote, and any cell; nothing is looked at twice.
_QUOTED = r'"(?:[^"]++|"")*+"[^,]*+'
_CELL = rf'(?:{_QUOTED}|(?!")[^,]*+)'
_ENDS_OUTSIDE = rf"\A{_CELL}(?:,{_CELL})*+\z"
_LEAVES = rf'\A(?:[^"]++|"")*+"[^,]*+(?:,{_CELL})*+\z'

# What a line does: nothing, turn over whether it is inside a cell, end outside, end inside.
KEEP, TURN, OUTSIDE, INSIDE = range(4)


def raw_lines(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """``(_file, _block, line, turn)``: the bytes of each line, and what it does to the state; only a line feed ends it.

    The number of tasks must not change between two scans, or blocks would begin elsewhere, so it
    is pinned in the session where nothing else does.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    text = F.col("value")
    # A line without quotes, which most are, is not looked at any further.
    quotes = F.contains(text, F.lit('"')) & F.lit(multi_line)
    outside, leaves = F.rlike(text, F.lit(_ENDS_OUTSIDE)), F.rlike(text, F.lit(_LEAVES))
    settled = F.when(outside & leaves, OUTSIDE).when(outside, KEEP).when(leaves, TURN).otherwise(INSIDE)
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        text.cast("binary").alias("line"), F.when(quotes, settled).otherwise(KEEP).cast("byte").alias("turn"),
    )


def states(turns: np.ndarray, inside: bool) -> np.ndarray:
    """Whether a cell is open at the end of each line."""
    settles = np.where(turns >= OUTSIDE, np.arange(1, len(turns) + 1), 0)
    last = np.maximum.accumulate(settles) if len(turns) else settles
    turned = np.concatenate([[0], np.cumsum(turns == TURN)])
    value = np.concatenate([[inside], turns == INSIDE])[last]
    return (value + turned[1:] - turned[last]) % 2 == 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of one block of one file after the other."""
    files, blocks = batch.column("_file").dictionary_encode(), np.asarray(batch.column("_block"))
    codes = np.asarray(files.indices)
    edges = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    edges = [0, *edges.tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:]):
        if low < high:
            yield (files.dictionary[codes[low]].as_py(), int(blocks[low])), batch.slice(low, high - low)


FLAGS = ("marked", "zeros", "valid", "returns")
SURVEY_SCHEMA = (
    "_file string, _block long, lines long, marked boolean, zeros boolean, valid boolean, returns boolean, "
    "out_ends boolean, in_ends boolean, out_opens boolean, in_opens boolean, header binary"
)


class _Survey:
    """What one block does, from either start."""

    def __init__(self, key: tuple[str, int]):
        self.key, self.lines, self.flags = key, 0, dict(marked=False, zeros=False, valid=True, returns=False)
        self.ends, self.opens = [False, True], [False, False]
        self.header, self.searched = [], key[1] == 0

    def take(self, rows: pa.RecordBatch) -> None:
        self.lines += rows.num_rows
        for name in FLAGS:
            found = np.asarray(rows.column(name), dtype=bool)
            self.flags[name] = bool(self.flags[name] and found.all() if name == "valid" else self.flags[name] or found.any())
        turns = np.asarray(rows.column("turn"))
        for start in (0, 1):
            after = states(turns, self.ends[start])
            before = np.concatenate([[self.ends[start]], after[:-1]])
            self.opens[start] |= bool((after & ~before).any())
            if start == 0 and self.searched:
                self._search(rows.column("line"), after)
            self.ends[start] = bool(after[-1])

    def _search(self, lines: pa.Array, inside: np.ndarray) -> None:
        """The first record that is not blank, from the lines of the first block of a file."""
        for line, more in zip(lines, inside.tolist()):
            line = line.as_py()
            if self.header or line.strip():
                self.header.append(line)
                if not more:
                    self.searched = False
                    return

    def row(self) -> dict:
        # A record without its end is no header.
        header = b"\n".join(self.header) if self.key[1] == 0 and not self.searched else None
        return {"_file": self.key[0], "_block": self.key[1], "lines": self.lines, **self.flags, "out_ends": self.ends[0],
                "in_ends": self.ends[1], "out_opens": self.opens[0], "in_opens": self.opens[1], "header": header}


SURVEY_TYPE = pa.schema([
    ("_file", pa.string()), ("_block", pa.int64()), ("lines", pa.int64()), *((name, pa.bool_()) for name in FLAGS),
    *((name, pa.bool_()) for name in ("out_ends", "in_ends", "out_opens", "in_opens")), ("header", pa.binary()),
])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        done = []
        for key, rows in _runs(batch):
            if now is None or key != now.key:
                done += [now.row()] if now else []
                now = _Survey(key)
            now.take(rows)
        yield pa.RecordBatch.from_pylist(done, SURVEY_TYPE)
    if now:
        yield pa.RecordBatch.from_pylist([now.row()], SURVEY_TYPE)


def survey_blocks(
    spark: SparkSession, path: str | list[str], encoding: str | None = None, multi_line: bool = True
) -> DataFrame:
    """One row per block: its file's encoding and first record, and how the block starts.

    ``inside`` tells that it starts within a quoted cell, and ``owner`` in which block the record open
    there began; ``broken`` that some cell of the file holds a line break. ``own_reader`` marks files
    that are left to Spark's reader. The blocks of one file, thousands at most, are put in order in one task.
    """
    line = F.col("line")
    marked = reduce(lambda a, b: a | b, [F.startswith(line, F.lit(mark)) for mark in UTF_16_MARKS])
    looked_at = raw_lines(spark, path, multi_line).select(
        "_file", "_block", "turn", marked.alias("marked"), F.contains(line, F.lit(b"\x00")).alias("zeros"),
        F.is_valid_utf8(line.cast("string")).alias("valid"), F.contains(line, F.lit(b"\r")).alias("returns"),
        # Only the first block of a file holds its header.
        F.when(F.col("_block") == 0, line).alias("line"),
    )
    blocks = looked_at.mapInArrow(_survey, SURVEY_SCHEMA)
    in_file = Window.partitionBy("_file")
    ordered = in_file.orderBy("_block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col("out_ends") & ~F.col("in_ends")
    blocks = blocks.withColumn("turned", F.count_if(turns).over(ordered))
    # The last block that settles the state, and how often it has been turned over since.
    settled = F.when(F.col("out_ends") == F.col("in_ends"), F.struct("out_ends", "turned"))
    blocks = blocks.withColumn("settled", F.last(settled, ignorenulls=True).over(before))
    blocks = blocks.withColumn("turned", F.coalesce(F.last("turned").over(before), F.lit(0)))
    since = F.col("turned") - F.coalesce(F.col("settled.turned"), F.lit(0))
    inside = F.coalesce(F.col("settled.out_ends"), F.lit(False)) != (since % 2 == 1)
    blocks = blocks.withColumn("inside", inside)
    opens = F.when(F.col("inside"), F.col("in_opens")).otherwise(F.col("out_opens"))
    blocks = blocks.withColumn("opens", opens)
    owner = F.last(F.when(F.col("opens"), F.col("_block")), ignorenulls=True).over(before)
    over_file = lambda f, name: f(name).over(in_file)
    wide = over_file(F.bool_or, "marked") & over_file(F.bool_or, "zeros")
    found = F.when(wide, UTF_16).when(over_file(F.bool_and, "valid"), UTF_8).otherwise(WESTERN)
    kind = F.lit(encoding) if encoding else found
    one_line = over_file(F.bool_or, "returns") & (over_file(F.sum, "lines") == 1)
    own_reader = (kind == UTF_16) | one_line
    # The bytes of a first line that is not read here only tell files apart.
    header = F.when(own_reader, F.hex("header")).otherwise(_record(_decoded(F.col("header"), kind)))
    return blocks.select(
        "_file", "_block", kind.alias("encoding"), own_reader.alias("own_reader"),
        over_file(F.bool_or, "opens").alias("broken"), "inside", F.when(F.col("inside"), owner).alias("owner"),
        header.alias("header"),
    )


SPLIT_SCHEMA = "_file string, _block long, _line long, owner long, first boolean, record binary"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the lines of a task, which come block by block in the order of the file."""
    now = None
    for batch in batches:
        for key, rows in _runs(batch):
            if now is None or key != now.key:
                if now:
                    yield from now.close()
                now = _Block(key, rows.column("inside")[0].as_py(), rows.column("owner")[0].as_py())
            yield now.take(rows.column("line"), np.asarray(rows.column("turn")))
    if now:
        yield from now.close()


class _Block:
    """Lines of one block on their way to records; what is open is held, no more."""

    def __init__(self, key: tuple[str, int], inside: bool, owner: int | None):
        self.key, self.inside = key, inside
        # The open lines, the number of their first one, and the block in which their record began.
        self.open: list[bytes] = []
        self.begun, self.owner = 0, owner if inside else key[1]
        self.line = 0
        self.header = key[1] == 0

    def _batch(self, records: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
        """Records as rows; the first one of a file that is not blank is its header."""
        first = [False] * len(records)
        for k, (_, _, record) in enumerate(records if self.header else []):
            if record.strip():
                first[k], self.header = True, False
                break
        lines, owners, texts = zip(*records) if records else ((), (), ())
        n = len(records)
        columns = [pa.array([self.key[0]] * n, pa.string()), pa.array([self.key[1]] * n, pa.int64()),
                   pa.array(lines, pa.int64()), pa.array(owners, pa.int64()), pa.array(first, pa.bool_()),
                   pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["_file", "_block", "_line", "owner", "first", "record"])

    def take(self, lines: pa.Array, turns: np.ndarray) -> pa.RecordBatch:
        records = []
        for line, inside in zip(lines.to_pylist(), states(turns, self.inside).tolist()):
            if not (self.open or self.inside):
                self.begun = self.line
            self.line += 1
            if inside:
                self.open.append(line)
                if not self.inside:
                    self.owner = self.key[1]
            else:
                fragment = self.inside and self.owner != self.key[1]
                record = b"\n".join([*self.open, line]) if self.open else line
                records.append((self.begun, self.owner if fragment else None, record))
                self.open, self.owner = [], self.key[1]
            self.inside = inside
        return self._batch(records)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self._batch([(self.begun, self.owner, b"\n".join(self.open))])


def _decoded(record: Column, encoding: Column) -> Column:
    """Bytes as the encoding of their file means them."""
    western = repaired(F.decode(record, spark_charset(WESTERN)), WESTERN)
    return F.when(encoding == WESTERN, western).otherwise(record.cast("string"))


def _record(text: Column) -> Column:
    """A record without a mark in front or a return behind: only its ends are looked at, however long it is."""
    text = F.when(F.endswith(text, F.lit("\r")), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(F.startswith(text, F.lit("\ufeff")), F.substr(text, F.lit(2))).otherwise(text)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def split_records(spark: SparkSession, path: str | list[str], blocks: DataFrame, multi_line: bool = True) -> DataFrame:
    """``(_file, _block, _line, first, record)`` of all files but those with ``own_reader``.

    ``first`` marks the first record of a file. ``blocks`` is a written ``survey_blocks``.
    """
    found = blocks.agg(F.count("*").alias("blocks"), F.bool_or("broken").alias("broken")).first()
    lines = raw_lines(spark, path, multi_line)
    starts = blocks.select("_file", "_block", "inside", "owner", "own_reader")
    if found.blocks > BROADCAST_ROWS:
        known = lines.withColumn("place", F.monotonically_increasing_id()).join(starts, ["_file", "_block"], "left")
        known = known.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "place")
    else:
        known = lines.join(F.broadcast(starts), ["_file", "_block"], "left")
    # Spark sizes blocks by the bytes of all files it scans, so files that are left out here are left out
    # after the scan: a condition on their names would take them out of the listing and move the blocks of the others.
    known = known.where(~F.coalesce("own_reader", F.lit(False)))
    lost = F.raise_error(F.lit("files were dealt out differently in two scans; read them again")).cast("boolean")
    inside = F.when(F.col("inside").isNull(), lost).otherwise(F.col("inside")).alias("inside")
    split = known.select("_file", "_block", "line", "turn", inside, "owner").mapInArrow(_split, SPLIT_SCHEMA)
    if found.broken:
        # Read twice below, and scanned once.
        split = materialize(split, "records", texts=True)
    kinds = blocks.where("_block = 0").select("_file", "encoding")
    split = split.join(small(kinds, found.blocks), "_file").withColumn("record", _decoded(F.col("record"), F.col("encoding")))
    whole = split.where(F.col("owner").isNull()).select("_file", "_block", "_line", "first", "record")
    if found.broken:
        # As long as one record, however many blocks it crosses.
        piece = F.struct("_block", "_line", "first", "record")
        pieces = split.where(F.col("owner").isNotNull()).groupBy("_file", "owner").agg(
            F.sort_array(F.collect_list(piece)).alias("pieces")
        )
        begun = F.get("pieces", F.lit(0))
        record = F.array_join(F.transform("pieces", lambda x: x["record"]), "\n")
        joined = pieces.select(
            "_file", F.col("owner").alias("_block"), begun["_line"].alias("_line"), begun["first"].alias("first"),
            record.alias("record"),
        )
        whole = whole.unionByName(joined)
    return whole.withColumn("record", _record(F.col("record"))).where(F.rlike("record", F.lit(r"[^\x20\x09-\x0D]")))


def own_reader_files(blocks: DataFrame) -> list[str]:
    return sorted(row._file for row in blocks.where("own_reader AND _block = 0").select("_file").collect())


def header_names(header: str) -> list[str]:
    """The columns that a first record names, each once: empty names and repeated ones get their place added."""
    cells = next(csv.reader([header], strict=False), [])
    counts: dict[str, int] = {}
    for cell in cells:
        counts[cell.lower()] = counts.get(cell.lower(), 0) + 1
    return [f"_c{k}" if not cell else f"{cell}{k}" if counts[cell.lower()] > 1 else cell for k, cell in enumerate(cells)]


def parsed(records: DataFrame, width: int) -> DataFrame:
    """``records`` with their cells in one array."""
    names = [f"c{k}" for k in range(width)]
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    row = F.from_csv("record", ", ".join(f"{name} STRING" for name in names), options)
    # Through an array of one, as each use of ``row`` would parse the record again.
    cells = F.transform(F.array(row), lambda x: F.array(*[x[name] for name in names]))
    return records.withColumn("cells", F.get(cells, F.lit(0))).drop("record")


def named_records(records: DataFrame, blocks: DataFrame, headers: list[str], names: list[str]) -> DataFrame:
    """The rows behind the headers, each cell under the name that its own file's header gives it.

    ``headers`` are the first records of all files, ``names`` the columns in the order that is wanted.
    """
    found = {header: header_names(header) for header in headers}
    for header, own in found.items():
        if sorted(own) != sorted(names):
            raise AnalysisException(f"files name other columns: {header!r} beside {', '.join(names)}")
    cells = parsed(records.where(~F.col("first")), len(names))
    if len(headers) == 1:
        places = [F.lit(found[headers[0]].index(name)) for name in names]
    else:
        # One row per file, with the number of its header.
        numbers = (F.array_position(F.array(*map(F.lit, headers)), F.col("header")) - 1).cast("int")
        of_file = blocks.where("_block = 0 AND NOT own_reader").select("_file", numbers.alias("header"))
        cells = cells.join(small(of_file, of_file.count()), "_file")
        table = F.array(*[F.array(*[F.lit(own.index(name)) for name in names]) for own in found.values()])
        places = [F.get(F.get(table, F.col("header")), F.lit(k)) for k in range(len(names))]
    order = [F.col(name) for name in ("_file", "_block", "_line")]
    return cells.select(*[F.get("cells", place).alias(name) for place, name in zip(places, names)], *order)
