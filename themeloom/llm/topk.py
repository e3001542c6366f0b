"""Exact top-k search by inner product, in tiles.

Components become integers by ``floor(scale * x)``. Queries are dealt into blocks
and candidates into shards of bounded size; every pair of a block and a shard is a
tile, multiplied as two matrices in one task. A tile keeps the best ``k`` of each
query, and the lists of a query are merged as a tree of fixed fan-in, so no task
gathers more than ``fan_in * k`` rows of a query. Neither side goes through the driver.

Scores are exact integers: a tile whose products stay below 2^53 uses floating-point
matrices, any other whole-number arithmetic; scores beyond 64 bits are set to the
nearest such number. Equal scores go to the smaller id, null ids last.

Vectors that are null or hold a null or non-finite component take no part; vectors of
different length are never compared. A query's own row is every row with its id.
Queries that repeat with the same vector are answered once; those that repeat an id
with another vector are answered each, and repeated candidates all count. A query
without candidates gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_ROWS = 4096
FAN_IN = 16
RESULT_SCHEMA = "query_id long, query_hash long, vec_id long, score long, shard long"


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    )


def _integers(rows: list[list[float]], scale: float) -> np.ndarray:
    """Whole numbers as floats; products beyond the range of a double become its greatest."""
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        scaled = scale * np.asarray(rows, dtype=np.float64).reshape(len(rows), -1)
    return np.floor(np.clip(scaled, -most, most))


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    if not queries.shape[1]:
        return np.zeros((len(queries), len(candidates)), dtype=np.int64)
    with np.errstate(over="ignore"):
        most = float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1]
    if most < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    limits = np.iinfo(np.int64)
    whole_q = [[int(x) for x in row] for row in queries.tolist()]
    whole_c = [[int(x) for x in row] for row in candidates.tolist()]
    exact = [[sum(map(int.__mul__, q, c)) for c in whole_c] for q in whole_q]
    return np.array([[min(max(s, limits.min), limits.max) for s in row] for row in exact], dtype=np.int64)


def best_of_tile(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, known: np.ndarray, candidates: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and the places and scores of its best candidates; ``ids`` in order, nulls last."""
    scores = _scores(queries, candidates)
    for place, query_id in enumerate(query_ids):
        row = scores[place]
        allowed = np.flatnonzero((ids != query_id) | ~known)
        if len(allowed) > k:
            # All that score as much as the k-th best; the first of them in order are the smallest ids.
            edge = np.partition(row[allowed], len(allowed) - k)[len(allowed) - k]
            allowed = allowed[row[allowed] >= edge]
        best = allowed[np.lexsort((allowed, ~row[allowed]))][:k]
        yield place, best, row[best]


def _tile_task(batches: Iterable[pa.RecordBatch], k: int, scale: float) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            names = ("tile_block", "tile_shard", "dims", "is_query", "id", "vec_hash", "vector")
            yield from zip(*(batch.column(name).to_pylist() for name in names))

    for (_, shard, _), group in itertools.groupby(rows(), key=lambda row: row[:3]):
        queries, others = [], []
        for row in group:
            (queries if row[3] else others).append(row[4:])
        if not queries or not others:
            continue
        others.sort(key=lambda row: (row[0] is None, row[0] or 0))
        known = np.array([row[0] is not None for row in others])
        ids = np.array([row[0] or 0 for row in others], dtype=np.int64)
        given = _integers([row[2] for row in others], scale)
        out: list[list] = [[], [], [], []]
        for first in range(0, len(queries), 256):
            some = queries[first : first + 256]
            found = best_of_tile(
                np.array([row[0] for row in some], dtype=np.int64),
                _integers([row[2] for row in some], scale),
                ids,
                known,
                given,
                k,
            )
            for place, best, scores in found:
                out[0] += [some[place][0]] * len(best)
                out[1] += [some[place][1]] * len(best)
                out[2] += [others[b][0] for b in best.tolist()]
                out[3] += scores.tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, pa.int64()) for column in (*out, [shard] * len(out[0]))],
            ["query_id", "query_hash", "vec_id", "score", "shard"],
        )


def _merged(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float = 256.0, vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score`` from tables with ``vec_id`` and a vector column."""
    values = F.col(vector).cast("array<double>")

    def prepared(rows: DataFrame) -> DataFrame:
        return rows.where(usable(vector)).select(F.col("vec_id").cast("long").alias("id"), values.alias("vector"))

    asked = prepared(queries).where("id IS NOT NULL").distinct().withColumn("vec_hash", F.xxhash64("vector"))
    given = prepared(candidates)
    blocks = max(1, math.ceil(asked.count() / TILE_ROWS))
    shards = max(1, math.ceil(given.count() / TILE_ROWS))
    # Rows are dealt by their place in the scan, so equal vectors and ids spread as well.
    dealt_q = asked.withColumn("tile_block", F.pmod(F.xxhash64("id", "vec_hash"), F.lit(blocks))).withColumn(
        "tile_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )
    dealt_c = given.withColumn("tile_shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards))).withColumn(
        "tile_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    columns = ["tile_block", "tile_shard", "dims", "is_query", "id", "vec_hash", "vector"]
    rows = dealt_q.withColumn("is_query", F.lit(True)).unionByName(
        dealt_c.withColumn("is_query", F.lit(False)).withColumn("vec_hash", F.lit(0).cast("long"))
    )
    rows = rows.withColumn("dims", F.size("vector")).select(*columns)
    keys = columns[:3]

    def run(batches):
        return _tile_task(batches, k, scale)

    lists = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, RESULT_SCHEMA)
    level = shards
    while level > FAN_IN:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        lists = _merged(lists, k, "query_id", "query_hash", "shard").drop("rank")
        level = math.ceil(level / FAN_IN)
    return _merged(lists, k, "query_id", "query_hash").select("query_id", "rank", "vec_id", "score")
