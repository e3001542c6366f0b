"""Codeframe lookup: one 0/1/NULL indicator per category and response column."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.config import UNCATEGORIZED
from themeloom.operators.reshape import unpivot_responses
from themeloom.tables import column, materialize, measured_bytes

WORD_BITS = 62  # categories per mask column
HOT_SHARE = 4  # an answer is hot when it fills more than 1/4 of an average shuffle partition
MOST_NEAR = 256  # hot answers whose masks are part of the plan, where a row compares its own with each
STREAM_SPREAD = 8  # places every answer of a stream is spread over, as none can be counted before


def indicator_name(category: str, response_column: str) -> str:
    return f"{category}_{response_column}"


def _unique(categories: Sequence[str]) -> list[str]:
    """Categories in first-seen order; repeats share one column."""
    unique = list(dict.fromkeys(categories))
    if UNCATEGORIZED not in unique:
        raise ValueError(f"the categories must include {UNCATEGORIZED!r}")
    return unique


def _check_names(df: DataFrame, added: list[str]) -> None:
    """Stop before two output columns share a name."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    names = df.columns + added
    seen = names if sensitive else [n.lower() for n in names]
    counts = Counter(seen)
    clashes = sorted({n for n, key in zip(names, seen) if counts[key] > 1})
    if clashes:
        raise ValueError(f"columns would share a name (see spark.sql.caseSensitive): {clashes}")


def _code_lists(codeframe: DataFrame) -> DataFrame:
    """Either form of codeframe as ``(response, codes ARRAY<STRING>)``."""
    if "categories" in codeframe.columns:
        return codeframe.select("response", F.coalesce("categories", F.array().cast("array<string>")).alias("codes"))
    return codeframe.select("response", F.array("category").alias("codes"))


def _default_masks(categories: list[str]) -> list[int]:
    place = categories.index(UNCATEGORIZED)
    words = -(-len(categories) // WORD_BITS)
    return [1 << place % WORD_BITS if w == place // WORD_BITS else 0 for w in range(words)]


def code_masks(codeframe: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``(response, mask)``: the indicators of each coded answer as bits, in an array of words.

    Codes are worked out here, once per distinct answer, so that applying them to
    the response table is a join and a shift. They are looked up in a table of the categories, so the
    plan is the same for three of them and for thousands. Codes outside ``categories`` do not
    count, and answers left without any code are dropped, as they are coded like
    an unknown answer; so is an entry for the empty answer. The helper category is set only when it comes last.
    An answer with two entries would double rows, and is an error instead; codeframes
    that were read or built here are already grouped by answer for this check.
    """
    names = _unique(categories)
    lists = _code_lists(codeframe).where(F.col("response") != "").groupBy("response")
    lists = lists.agg(F.count(F.lit(1)).alias("entries"), F.first("codes").alias("codes"))
    repeated = F.raise_error(F.concat(F.lit("answer coded more than once: "), F.col("response")))
    lists = lists.select("response", F.when(F.col("entries") == 1, F.col("codes")).otherwise(repeated.cast("array<string>")).alias("codes"))
    # As many rows as there are output columns.
    places = codeframe.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "code string, place int")
    found = lists.select("response", F.posexplode("codes").alias("rank", "code")).join(F.broadcast(places), "code")
    coded = found.groupBy("response").agg(F.collect_set("place").alias("places"), F.max_by("place", "rank").alias("last"))
    helper = names.index(UNCATEGORIZED)
    given = F.when(F.col("last") == helper, F.col("places")).otherwise(F.array_remove("places", helper))
    coded = coded.select("response", given.alias("places"))

    def word(w: Column) -> Column:
        own = F.filter("places", lambda place: F.floor(place / WORD_BITS) == w)
        one = F.lit(1).cast("long")
        bits = F.transform(own, lambda place: F.call_function("shiftleft", one, place % WORD_BITS))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda mask, bit: mask.bitwiseOR(bit))

    words = F.sequence(F.lit(0), F.lit((len(names) - 1) // WORD_BITS))
    return coded.select("response", F.transform(words, word).alias("mask"))


def _written_masks(codeframe: DataFrame, categories: list[str]) -> DataFrame:
    """The masks as a written table."""
    return materialize(code_masks(codeframe, categories), "code-masks")


def hot_digests(answers: DataFrame, partitions: int) -> list[int]:
    """Digests of the answers that fill much of a shuffle partition: at most four per partition.

    One pass over ``(id, response columns)``, counting 8-byte digests, which the
    tasks combine before the shuffle.
    """
    digest = F.xxhash64("response").alias("digest")
    counts = unpivot_responses(answers).where(F.col("response") != "").groupBy(digest).agg(F.count("*").alias("n"))
    counts = materialize(counts, "answer-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * F.lit(HOT_SHARE * partitions) > F.lit(total))
    return [row.digest for row in hot.orderBy(F.desc("n")).collect()]


def _broadcast_lookup(df: DataFrame, name: str, masks: DataFrame, suffix: str) -> DataFrame:
    """Left join one response column to its masks, as ``mask_<suffix>``."""
    key = f"_key_{suffix}"
    side = masks.withColumnsRenamed({c: key if c == "response" else f"{c}_{suffix}" for c in masks.columns})
    return df.join(F.broadcast(side), column(name) == F.col(key), "left").drop(key)


def _shuffled_lookup(
    df: DataFrame, name: str, masks: DataFrame, suffix: str, hot: list[int] | None, spread: int, spread_by: Sequence[str]
) -> DataFrame:
    """The same where rows and masks meet by the digest of the answer.

    The masks of a hot answer are sent to ``spread`` places, and each of its rows to
    the one that the digest of ``spread_by`` names; so are rows that need no lookup,
    which meet no masks anywhere. ``hot=None`` spreads every answer.
    """
    key, side_place = f"_key_{suffix}", f"_place_{suffix}"
    side = masks.withColumnsRenamed({c: key if c == "response" else f"{c}_{suffix}" for c in masks.columns})

    def is_hot(digest: Column) -> Column:
        return F.lit(True) if hot is None else digest.isin(hot) if hot else F.lit(False)

    every = F.sequence(F.lit(0), F.lit(spread - 1))
    salts = F.when(is_hot(F.xxhash64(key)), every).otherwise(F.array(F.lit(0)))
    side = side.withColumn("_salt", F.explode(salts))
    side = side.withColumn(side_place, F.xxhash64(F.xxhash64(key), "_salt")).drop("_salt")
    own = F.xxhash64(*[column(c) for c in spread_by])
    digest = F.xxhash64(column(name))
    salt = F.when(is_hot(digest), F.pmod(own, F.lit(spread)).cast("int")).otherwise(F.lit(0))
    needless = column(name).isNull() | (column(name) == "")
    df = df.withColumn("_place", F.when(needless, own).otherwise(F.xxhash64(digest, salt)))
    same = (F.col("_place") == F.col(side_place)) & (column(name) == F.col(key))
    # The size was measured; Spark's own estimate from compressed files must not bring the broadcast back.
    return df.join(side.hint("merge"), same, "left").drop(key, side_place, "_place")


def _narrow_lookup(
    df: DataFrame, response_columns: Sequence[str], masks: DataFrame, partitions: int
) -> tuple[DataFrame, list[Column]]:
    """All response columns looked up at once: only digests meet the masks, and a row is moved once at most.

    The rows are written with a number. The masks of frequent answers, which are few, go into the plan. The other
    answers become a long table of (row, column, digest), which is joined to the masks by digest as one
    response column is; the masks found come back as one entry per row, to which the row is joined
    by its number. Rows with frequent, empty and missing answers only are not moved.
    """
    df = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "responses")
    texts = [F.when(column(name) != "", F.md5(column(name))) for name in response_columns]
    names = [f"c{i}" for i in range(len(response_columns))]
    hot = hot_digests(df.select("_row", *[text.alias(c) for c, text in zip(names, texts)]), partitions)
    near, far = hot[:MOST_NEAR], hot[MOST_NEAR:]

    def is_near(text: Column) -> Column:
        return F.xxhash64(text).isin(near) if near else F.lit(False)

    side = masks.select(F.md5("response").alias("response"), "mask")
    entries = side.where(is_near(F.col("response"))).collect()
    keys = F.from_json(F.lit(json.dumps([r.response for r in entries])), "array<string>")
    values = F.from_json(F.lit(json.dumps([r.mask for r in entries])), "array<array<bigint>>")
    known = [F.get(values, F.array_position(keys, text).cast("int") - 1) for text in texts]
    others = [F.when(~is_near(text), text) for text in texts]
    moves = reduce(lambda a, b: a | b, [text.isNotNull() for text in others])
    rows = df.select("*", *[value.alias(f"_known_{c}") for c, value in zip(names, known)], moves.alias("_moves"))

    long = unpivot_responses(df.select("_row", *[text.alias(c) for c, text in zip(names, others)]))
    found = _shuffled_lookup(long, "response", side, "found", far, partitions, ["_row", "response_column"])
    found = found.where(F.col("mask_found").isNotNull()).groupBy("_row").agg(
        *[F.max(F.when(F.col("response_column") == c, F.col("mask_found"))).alias(f"_mask_{c}") for c in names]
    )
    # One row per number on both sides; measured as too large to broadcast.
    moved = rows.where("_moves").join(found.hint("merge"), "_row", "left")
    own = [column(c) for c in df.columns if c != "_row"]
    stay = rows.where("NOT _moves").select(*own, *[F.col(f"_known_{c}").alias(f"_mask_{c}") for c in names])
    both = [F.coalesce(f"_mask_{c}", f"_known_{c}").alias(f"_mask_{c}") for c in names]
    return stay.unionByName(moved.select(*own, *both)), [F.col(f"_mask_{c}") for c in names]


def _with_masks(
    df: DataFrame,
    response_columns: Sequence[str],
    codeframe: DataFrame,
    categories: list[str],
    broadcast_bytes: int,
    spread_by: Sequence[str],
) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` joined to the codeframe, and the mask column of each response column.

    The codeframe is turned into masks, written once and measured. While it fits,
    each response column is one broadcast hash join and ``df`` is never shuffled.
    Beyond that rows meet their codes by a shuffle, in which the few very frequent
    answers, and missing and empty ones, are spread evenly over all tasks; of several response
    columns only digests are shuffled for that, and the rows once, however many columns there are.
    """
    masks = _written_masks(codeframe, categories)
    small = measured_bytes(masks) <= broadcast_bytes
    if not small and not df.isStreaming:
        spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if len(response_columns) > 1:
            df, found = _narrow_lookup(df, response_columns, masks, spread)
            return df, dict(zip(response_columns, found))
        hot = hot_digests(df.select(F.lit(0).alias("_id"), *[column(c) for c in response_columns]), spread)
    else:
        hot, spread = None, STREAM_SPREAD
    for i, name in enumerate(response_columns):
        if small:
            df = _broadcast_lookup(df, name, masks, f"c{i}")
        else:
            df = _shuffled_lookup(df, name, masks, f"c{i}", hot, spread, spread_by)
    return df, {name: F.col(f"mask_c{i}") for i, name in enumerate(response_columns)}


def _indicator(word: Column, place: int) -> Column:
    return F.shiftright(word, place % WORD_BITS).bitwiseAND(F.lit(1))


def _word(mask: Column, place: int) -> Column:
    return F.get(mask, F.lit(place // WORD_BITS))


def categorize(
    df: DataFrame,
    codeframe: DataFrame,
    categories: Sequence[str],
    broadcast_bytes: int = 128 * 1024 * 1024,
) -> DataFrame:
    """The id and cleaned answers with every indicator of every response column.

    * missing answer: NULL in all its indicators;
    * answer with known codes: 1 for these, 0 elsewhere;
    * any other answer, the empty one included: only ``Uncategorized`` is 1.

    One projection over lookup joins; see ``_with_masks`` for how these run. The
    codeframe must hold each answer once.
    """
    names = _unique(categories)
    id_column, *response_columns = df.columns
    _check_names(df, [indicator_name(c, r) for r in response_columns for c in names])
    coded, found = _with_masks(df, response_columns, codeframe, names, broadcast_bytes, [id_column])
    defaults = _default_masks(names)
    held = {
        name: [f"_mask_{i}_{w}" for w in range(len(defaults))] for i, name in enumerate(response_columns)
    }
    full = [
        F.when(column(name).isNotNull(), F.coalesce(F.get(found[name], F.lit(w)), F.lit(default))).alias(held[name][w])
        for name in response_columns
        for w, default in enumerate(defaults)
    ]
    kept = [column(c) for c in df.columns]
    indicators = [
        _indicator(F.col(held[name][place // WORD_BITS]), place).alias(indicator_name(category, name))
        for name in response_columns
        for place, category in enumerate(names)
    ]
    return coded.select(*kept, *full).select(*kept, *indicators)


def default_indicators(df: DataFrame, response_columns: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Append the indicators of uncoded answers: 1 for ``Uncategorized``, else 0."""
    names = _unique(categories)
    _check_names(df, [indicator_name(c, r) for r in response_columns for c in names])
    added = [
        F.lit(int(c == UNCATEGORIZED)).cast("long").alias(indicator_name(c, r))
        for r in response_columns
        for c in names
    ]
    return df.select("*", *added)


def missing_to_null(df: DataFrame, response_column: str, categories: Sequence[str]) -> DataFrame:
    """NULL in one response column's indicators where its answer is missing."""
    own = {indicator_name(c, response_column) for c in categories}
    present = column(response_column).isNotNull()
    return df.select(*[F.when(present, column(c)).alias(c) if c in own else column(c) for c in df.columns])


def apply_codes(
    df: DataFrame,
    response_column: str,
    codeframe: DataFrame,
    categories: Sequence[str],
    broadcast_bytes: int = 128 * 1024 * 1024,
) -> DataFrame:
    """Set one response column's existing indicators from the codeframe.

    Matched answers get 1 for their codes and the helper category reset; other
    indicators keep their values. Works for single and multiple codes alike.
    """
    names = _unique(categories)
    coded, found = _with_masks(df, [response_column], codeframe, names, broadcast_bytes, df.columns)
    own = {indicator_name(c, response_column): c for c in names}
    place = {c: i for i, c in enumerate(names)}

    def updated(name: str) -> Column:
        bit = _indicator(_word(found[response_column], place[own[name]]), place[own[name]])
        change = bit.isNotNull() if own[name] == UNCATEGORIZED else bit == 1
        return F.when(change, bit).otherwise(column(name)).alias(name)

    return coded.select(*[updated(c) if c in own else column(c) for c in df.columns])
