"""CSV in and out, in the dialect spreadsheets and pandas use."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.functions.literals import string_list
from themeloom.sources.encodings import UTF_8, UTF_16, repaired, spark_charset
from themeloom.sources.records import (
    header_names,
    named_records,
    own_reader_files,
    parsed,
    split_records,
    survey_blocks,
)
from themeloom.tables import column, materialize, quoted

# Cell texts that mean a missing answer, matched exactly.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_ORDER = ("_file", "_block", "_line")
RUN_BITS = 16  # of a line's number that tell the lines of one run apart


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    header: bool = True,
    encoding: str = "utf-8",
    multi_line: bool = True,
    names: Sequence[str] = (),
    file_order: bool = False,
) -> DataFrame:
    """Every column as text. Quotes are doubled, and may enclose line breaks.

    ``multi_line=False`` lets Spark split large files, for data that has no line
    breaks inside answers; UTF-16 is read whole all the same, as its line ends are
    no single bytes. ``names`` gives the columns of a file without a header.
    ``file_order`` adds three columns that sort rows as the files hold them.
    """
    reader = (
        spark.read.option("header", header)
        .option("multiLine", multi_line or encoding == UTF_16)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", spark_charset(encoding))
    )
    if names:
        reader = reader.schema(", ".join(f"{quoted(name)} STRING" for name in names))
    df = reader.csv(path)
    texts = [repaired(column(c), encoding).alias(c) for c in df.columns]
    if not file_order:
        return df.select(*texts)
    # The running number only has to order rows of one block of one file, which
    # a single task reads from start to end.
    order = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.select(*texts, *[value.alias(name) for value, name in zip(order, _ORDER)])


def _own_files(df: DataFrame, files: list[str]) -> DataFrame:
    """The rows of some files; Spark opens no other."""
    return df.where(F.col("_file").isin(files))


# Different headers, in any encoding, among the files of one folder.
MOST_HEADERS = 1_000


def read_table(
    spark: SparkSession,
    path: str | list[str],
    encoding: str | None = None,
    multi_line: bool = True,
    names: Sequence[str] = (),
) -> DataFrame:
    """Every column of the files as text, with three columns that sort rows as the files hold them.

    Without ``encoding`` every file's own is detected. ``names`` gives the columns of files without
    headers. Files may name the same columns in another order; the first file gives the order. Each
    file is surveyed once and read once, by as many tasks as it has blocks, whatever cells
    hold; ``multi_line=False`` takes every line for a record, for files with stray quotes.
    """
    blocks = materialize(survey_blocks(spark, path, encoding, multi_line), "blocks")
    # One row per encoding and first record: few, however many files.
    kinds = blocks.where("_block = 0").groupBy("encoding", "own_reader", "header" if not names else F.lit("").alias("header"))
    kinds = kinds.agg(F.min("_file").alias("sample"), F.bool_or("broken").alias("broken")).orderBy("sample")
    kinds = kinds.limit(MOST_HEADERS + 1).collect()
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"the files under {path} have more than {MOST_HEADERS} different headers")
    if len(kinds) <= 1 and not (kinds and kinds[0].broken and not kinds[0].own_reader):
        # What Spark's own reader does in many tasks, or has to do in one.
        found, whole = (kinds[0].encoding, kinds[0].own_reader) if kinds else (encoding or UTF_8, False)
        return read_csv(spark, path, not names, found, multi_line=whole, names=names, file_order=True)
    options = {"header": not names, "multi_line": True, "file_order": True}
    parts, order = [], list(names)
    for kind in kinds if not names else []:
        if kind.own_reader:
            own = read_csv(spark, kind.sample, encoding=kind.encoding).columns
        elif kind.header is None:
            raise ValueError(f"the first record of {kind.sample} is longer than a block")
        else:
            own = header_names(kind.header)
        order = order or own
        if kind.own_reader:
            same = (F.col("encoding") == kind.encoding) & F.col("header").eqNullSafe(F.lit(kind.header))
            part = read_csv(spark, path, encoding=kind.encoding, names=own, **options)
            parts.append(_own_files(part, own_reader_files(blocks.where(same))).select(*map(column, [*order, *_ORDER])))
    if names:
        for found in sorted({kind.encoding for kind in kinds if kind.own_reader}):
            part = read_csv(spark, path, encoding=found, names=names, **options)
            parts.append(_own_files(part, own_reader_files(blocks.where(F.col("encoding") == found))))
    headers = sorted({kind.header for kind in kinds if not kind.own_reader and kind.header is not None})
    if headers:
        records = split_records(spark, path, blocks, multi_line)
        if names:
            cells = parsed(records, len(names))
            parts.append(cells.select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)], *_ORDER))
        else:
            parts.append(named_records(records, blocks, headers, order))
    return reduce(DataFrame.unionByName, parts)


def _known_texts(df: DataFrame) -> DataFrame:
    """Cells that stand for nothing as NULL, without the columns of the order."""
    names = [name for name in df.columns if name not in _ORDER]
    return df.select(*[F.when(~column(c).isin(list(NA_TOKENS)), column(c)).alias(c) for c in names])


def read_responses(
    spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = True
) -> DataFrame:
    """A response table: header row, id first, answers after, missing ones NULL; see ``read_table``."""
    return _known_texts(read_table(spark, path, encoding, multi_line))


def category_rows(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """``(ord, category)``: the first column of a headerless file, in file order, missing ones dropped.

    Lists may be long: rows are ranked within runs of lines, and only the sizes of the runs are summed in one place.
    """
    rows = read_table(spark, path, encoding, names=["category"]).where(~F.col("category").isin(list(NA_TOKENS)))
    rows = rows.withColumn("_run", F.shiftright("_line", RUN_BITS))
    run = ["_file", "_block", "_run"]
    earlier = Window.orderBy(*run).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*run).agg(F.count("*").alias("_size"))
    starts = sizes.select(*run, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    # A run holds a row at least, so its start is its own; only numbers and names are shuffled.
    started = rows.join(F.broadcast(starts), run).select("_start", "_line", "category")
    place = F.row_number().over(Window.partitionBy("_start").orderBy("_line")) - 1
    return started.select((F.col("_start") + place).cast("int").alias("ord"), "category")


def read_categories(spark: SparkSession, path: str, encoding: str | None = None) -> list[str]:
    """The names of ``category_rows`` on the driver, where columns and prompts are made of them."""
    return [row.category for row in category_rows(spark, path, encoding).orderBy("ord").collect()]


def _read_codeframe(spark: SparkSession, path: str) -> DataFrame:
    """``(response, value, place)`` of a key/value file, the last of equal keys."""
    rows = read_table(spark, path, encoding=UTF_8)
    if not {"key", "value"} <= set(rows.columns):
        raise ValueError(f"a codeframe needs the columns key and value: {path}")
    raw = F.when(~F.col("value").isin(list(NA_TOKENS)), F.col("value"))
    return (
        rows.where(F.col("key").isNotNull())
        .select(F.col("key").alias("response"), F.struct(*_ORDER).alias("_place"), raw.alias("_value"))
        .groupBy("response")
        .agg(F.max_by(F.struct("_value"), "_place").alias("_last"))
        .select("response", F.col("_last._value").alias("value"))
    )


def read_codeframe_single(spark: SparkSession, path: str) -> DataFrame:
    """``(response, category)``, unique on ``response``."""
    return _read_codeframe(spark, path).withColumnRenamed("value", "category")


def read_codeframe_multi(spark: SparkSession, path: str) -> DataFrame:
    """``(response, categories)`` from list texts, unique on ``response``.

    Lists may be written by Python or as JSON. A missing list is empty; a malformed one is an error.
    """
    value = F.col("value")
    malformed = F.raise_error(F.concat(F.lit("malformed list in codeframe: "), value)).cast("array<string>")
    lists = F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(string_list(value), malformed))
    return _read_codeframe(spark, path).select("response", lists.alias("categories"))


def _refuse_empty(df: DataFrame, path: str) -> None:
    if df.isEmpty():
        raise ValueError(f"nothing to write to {path}")


def write_csv(
    df: DataFrame,
    path: str,
    header: bool = True,
    one_file: bool = False,
    rows_from: DataFrame | None = None,
    mode: str = "error",
    keep_empty: bool = False,
) -> None:
    """Write a folder of CSV parts; an empty table is an error and writes nothing.

    ``rows_from`` names an input that is empty just when ``df`` is, so that the
    check does not start the whole plan. ``one_file`` keeps the row order of
    ``df`` in a single part, for small files that people hand on. ``keep_empty``
    writes empty texts as a pair of quotes, which Spark's reader tells from a
    missing cell if its ``nullValue`` is a text that no cell holds.
    """
    _refuse_empty(df if rows_from is None else rows_from, path)
    (
        (df.coalesce(1) if one_file else df)
        .write.mode(mode)
        .option("header", header)
        .option("escape", '"')
        .option("emptyValue", '""' if keep_empty else "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, rows_from: DataFrame | None = None, mode: str = "error") -> None:
    """As ``write_csv``, in the form large tables should take."""
    _refuse_empty(df if rows_from is None else rows_from, path)
    df.write.mode(mode).parquet(path)


def codeframe_rows(codeframe: DataFrame) -> DataFrame:
    """A codeframe as ``(key, value)`` text, lists written as JSON."""
    value = F.to_json("categories") if "categories" in codeframe.columns else F.col("category")
    return codeframe.select(F.col("response").alias("key"), value.alias("value"))


def write_codeframe(
    codeframe: DataFrame,
    path: str,
    header: bool = True,
    mode: str = "error",
    rows_from: DataFrame | None = None,
) -> None:
    """Write a codeframe as ``key,value``; an empty one is an error."""
    write_csv(codeframe_rows(codeframe), path, header=header, mode=mode, rows_from=rows_from)
