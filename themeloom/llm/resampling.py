"""Documents drawn towards a target distribution by hashed n-gram importance weights.

Words are runs of letters a to z, digits and anything beyond ASCII, after A-Z is lower-cased.
A document's features are all its runs of one and two words, repeats counted; a feature's
bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. One pass counts the buckets of
all documents and of all target texts, and a bucket's gain is 1000 times the log ratio of
their smoothed shares, floored. A second pass looks the gains up in one array and takes the
floored mean over a document's features, without features 0. The score adds Gumbel noise
from a hash of the id, so the highest scores are a draw without repetition.

The cut is located without sorting the scores: a quantile sketch gives a bracket around it,
exact counts outside hold the bracket to be right or widen it, the bracket is sketched again
while it is large, and only what is left of it is sorted. Drawn rows are numbered in ranges.

Nulls: a null text has no words; a null id is written as nothing in the hash and comes last
among equal scores. Empty tables, and texts below ``least_words`` only, draw nothing. Repeated
rows are drawn one by one, in the order of the scan among equals. Only the id and the text
of a document are looked at, whatever other columns there are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.arrow import blobs, cut_by_bytes, map_texts
from themeloom.tables import materialize

# Bytes of text that are looked at together.
CHUNK_BYTES = 2_000_000
# Words up to this length take part in array code; a longer one is looked at alone.
LONG_WORD = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def _shift_tables() -> np.ndarray:
    """``[n, k, byte]``: what byte k of a CRC state becomes after n zero bytes."""
    tables = np.empty((LONG_WORD + 2, 4, 256), dtype=np.uint32)
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for n in range(LONG_WORD + 2):
            tables[n, k] = state
            state = CRC[state & 255] ^ (state >> np.uint32(8))
    return tables


SHIFT = _shift_tables()

# Letters of words stay, A-Z in lower case; all else parts words and becomes a zero.
LETTER = np.zeros(256, dtype=np.uint8)
for _byte in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    LETTER[_byte] = _byte
LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)


def feature_buckets(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; the buckets of all features of all texts; the text each belongs to.

    The CRC of two words with a space between follows from theirs, as the state after the
    first only has to be moved past the bytes of the second.
    """
    flat = LETTER[np.frombuffer(b"\x00".join(t or b"" for t in texts) + b"\x00", dtype=np.uint8)]
    ends_of_texts = np.cumsum([len(t or b"") + 1 for t in texts])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (flat > 0).astype(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    text = np.searchsorted(ends_of_texts, starts, side="right")
    states = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    begins = np.searchsorted(lengths[order], np.arange(1, LONG_WORD + 1))
    longer = int(np.searchsorted(lengths[order], LONG_WORD, side="right"))
    for place, first in enumerate(begins):
        if first >= longer:
            break
        now = order[first:longer]
        states[now] = CRC[(states[now] ^ flat[starts[now] + place]) & 255] ^ (states[now] >> np.uint32(8))
    alone = order[longer:]
    for k in alone:
        states[k] = zlib.crc32(flat[starts[k] : ends[k]].tobytes()) ^ 0xFFFFFFFF
    single = states ^ np.uint32(0xFFFFFFFF)

    left = np.flatnonzero(text[1:] == text[:-1])
    # After the first word and a space; its bytes then move on past the second word, whose own
    # CRC, begun from nothing, is the XOR of what the same move makes of the usual start.
    before = CRC[(states[left] ^ np.uint32(0x20)) & 255] ^ (states[left] >> np.uint32(8))
    moved = before ^ np.uint32(0xFFFFFFFF)
    steps = np.minimum(lengths[left + 1], LONG_WORD + 1)
    double = single[left + 1].copy()
    for k in range(4):
        double ^= SHIFT[steps, k, (moved >> np.uint32(8 * k)) & 255]
    for at in np.flatnonzero(lengths[left + 1] > LONG_WORD):
        k = left[at] + 1
        double[at] = zlib.crc32(flat[starts[k] : ends[k]].tobytes(), int(before[at]) ^ 0xFFFFFFFF)
    found = np.concatenate([single, double]) % np.uint32(buckets)
    return np.bincount(text, minlength=len(texts)), found, np.concatenate([text, text[left]])


def bucket_counts(texts: DataFrame, column: str, buckets: int) -> np.ndarray:
    """How often each bucket is met in all texts; summed by Spark, ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in cut_by_bytes(batches, "text", CHUNK_BYTES):
            total += np.bincount(feature_buckets(blobs(batch.column("text")), buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    rows = map_texts(texts.select(F.col(column).cast("binary").alias("text")), count, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier each bucket is in the target, smoothed by one, floored."""
    wider, narrower = int(documents.sum()) + len(documents), int(target.sum()) + len(target)
    ratios = [(float(t + 1) * wider) / (float(s + 1) * narrower) for s, t in zip(documents.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], dtype=np.int64)


def weigh(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every document."""
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_by_bytes(batches, "text", CHUNK_BYTES):
            words, found, owner = feature_buckets(blobs(batch.column("text")), buckets)
            features = np.bincount(owner, minlength=len(words))
            # Whole numbers far below 2^53, so these sums of doubles are exact.
            sums = np.bincount(owner, weights=gain[found], minlength=len(words)).astype(np.int64)
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            columns = [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, features, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_texts(rows, score, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate from the hash of the id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


# --- the cut -----------------------------------------------------------------

KEYS = ("k0", "k1", "k2")


def _bracket(rows: DataFrame, key: str, need: int, total: int, accuracy: int) -> tuple[int, int, int, int]:
    """``(low, high, below, within)`` of a bracket that holds the ``need``-th least ``key``, proven by exact counts."""
    slack = 2.0
    while True:
        share = [min(1.0, max(0.0, need / total + side * slack / accuracy)) for side in (-1, 1)]
        sketch = F.percentile_approx(key, F.array(*map(F.lit, share)), F.lit(accuracy))
        ends = rows.agg(sketch.alias("q"), F.min(key).alias("least"), F.max(key).alias("most")).first()
        low = ends.least if share[0] == 0 else ends.q[0]
        high = ends.most if share[1] == 1 else ends.q[1]
        counts = rows.agg(
            F.count_if(F.col(key) < low).alias("below"), F.count_if(F.col(key) <= high).alias("upto")
        ).first()
        if counts.below < need <= counts.upto:
            return low, high, counts.below, counts.upto - counts.below
        slack *= 8


def locate(rows: DataFrame, need: int, total: int, accuracy: int = 10_000, most_sorted: int = 100_000) -> tuple:
    """The keys of the row that is ``need``-th of ``total`` by ``KEYS``; at most ``most_sorted`` rows are sorted."""
    for key in KEYS:
        while total > most_sorted:
            low, high, below, within = _bracket(rows, key, need, total, accuracy)
            rows, need, shrunk, total = rows.where(F.col(key).between(low, high)), need - below, within < total, within
            if low == high or not shrunk:
                break
    best = rows.select(*KEYS).orderBy(*KEYS).limit(need)
    return tuple(best.agg(F.max(F.struct(*KEYS)).alias("last")).first().last)


def _numbered(rows: DataFrame, count: int, rows_per_range: int) -> DataFrame:
    """``rows`` with their place from 1 by ``KEYS``: ranges are numbered apart, their sizes summed."""
    ranges = -(-count // rows_per_range)
    dealt = rows.repartitionByRange(ranges, *KEYS).withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    # One row per range of ``rows_per_range`` rows.
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("range")) - F.col("size")
    within = F.row_number().over(Window.partitionBy("range").orderBy(*KEYS))
    return dealt.join(sizes.select("range", before.alias("before")), "range").withColumn("rank", F.col("before") + within)


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    buckets: int = 10_000,
    seed: int = 7,
    rows_per_range: int = 500_000,
    **bracketing: int,
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every document, ``rank`` null where not drawn.

    Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn, rounded down.
    """
    gain = gains(bucket_counts(documents, "text", buckets), bucket_counts(target, "text", buckets))
    rows = weigh(documents, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    # Ascending keys that no two rows share: the score, the id, the place in the scan. The table
    # is written, so a place stays what it is when a task runs again.
    last = F.lit(2**63 - 1)
    rows = rows.withColumns(
        {"k0": -F.col("score"), "k1": F.coalesce("doc_id", last), "k2": F.monotonically_increasing_id()}
    )
    scored = materialize(rows, "scored")
    results = ["doc_id", "n_words", "n_features", "weight", "score"]
    able = F.col("n_words") >= least_words
    total = scored.where(able).count()
    need = total * percent // 100
    if not need:
        return scored.select(*results, F.lit(None).cast("long").alias("rank"))
    cut = locate(scored.where(able), need, total, **bracketing)
    drawn = able & (F.struct(*KEYS) <= F.struct(*[F.lit(k).cast("long").alias(name) for k, name in zip(cut, KEYS)]))
    ranked = _numbered(scored.where(drawn), need, rows_per_range).select(*results, "rank")
    return ranked.unionByName(scored.where(~drawn).select(*results, F.lit(None).cast("long").alias("rank")))
