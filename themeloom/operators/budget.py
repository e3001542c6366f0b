"""Admission times for requests under per-minute limits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.tables import column

BLOCK_ROWS = 100_000  # requests per window partition
MINUTE_US = 60_000_000


def _over(amount: Column, limit: int) -> Column:
    """Microseconds one minute's ``limit`` takes to cover ``amount``, rounded up.

    Whole minutes and the rest are kept apart, so that large totals stay exact.
    """
    rest = amount % limit
    minutes = ((amount - rest) / limit).cast("long")
    return minutes * MINUTE_US + F.ceil(rest * MINUTE_US / limit).cast("long")


class Buckets:
    """Two allowances that refill steadily up to one minute's worth, in whole parts of a microsecond.

    A state is the time of the last admission and, for each allowance, the time at which it is full
    again. A request moves it by maxima and sums only, so a run of requests is a matrix of such
    moves, and runs are joined by the product of their matrices.
    """

    FAR = -(10**30)

    def __init__(self, tokens_per_minute: int, requests_per_minute: int):
        limits = (tokens_per_minute, requests_per_minute)
        # The least unit in which one token and one request take whole times to come back.
        self.parts = math.lcm(*[limit // math.gcd(MINUTE_US, limit) for limit in limits])
        self.minute = MINUTE_US * self.parts
        self.token, self.request = (self.minute // limit for limit in limits)

    def start(self, full: bool) -> tuple[int, int, int]:
        return (0, 0, 0) if full else (0, self.minute, self.minute)

    def admit(self, state: Sequence[int], costs: Sequence[int | None]) -> tuple[list[int | None], tuple[int, int, int]]:
        """When each request may go, first come first served, and the state behind them; ``None`` never goes."""
        now, tokens, requests = state
        times: list[int | None] = []
        for cost in costs:
            if cost is None:
                times.append(None)
                continue
            weight = cost * self.token
            now = max(now, tokens + weight - self.minute, requests + self.request - self.minute)
            tokens, requests = max(tokens, now) + weight, max(requests, now) + self.request
            times.append(now)
        return times, (now, tokens, requests)

    def matrix(self, costs: Sequence[int | None]) -> list[int | None]:
        """What the requests add to each part of a state on the way to each part, row by row."""
        rows = [self.admit([0 if k == part else self.FAR for k in range(3)], costs)[1] for part in range(3)]
        return [value if value > self.FAR // 2 else None for row in rows for value in row]

    @staticmethod
    def moved(state: Sequence[int], matrix: Sequence[int | None]) -> tuple[int, ...]:
        return tuple(
            max(state[row] + matrix[3 * row + to] for row in range(3) if matrix[3 * row + to] is not None)
            for to in range(3)
        )


# Parts of a microsecond may pass 64 bits.
_WIDE = pa.decimal128(38, 0)


def _decimals(values: Sequence[int | None]) -> list[Decimal | None]:
    return [None if value is None else Decimal(value) for value in values]


def _block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one block, in order."""
    for batch in batches:
        blocks = batch.column("_block").to_pylist()
        edges = [k for k in range(len(blocks)) if k == 0 or blocks[k] != blocks[k - 1]]
        for low, high in zip(edges, [*edges[1:], len(blocks)]):
            yield blocks[low], batch.slice(low, high - low)


def _block_states(charged: DataFrame, order: str, buckets: Buckets, full: bool) -> DataFrame:
    """``(_block, _state)``: the state before each block.

    Blocks become matrices apart from each other; one task then joins them, at one row per block.
    """

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, matrix = None, None
        for block, rows in _block_runs(batches):
            if block != now and matrix:
                yield _row(now, matrix)
            costs = rows.column("_cost").to_pylist()
            if block == now:
                joined = [Buckets.moved(_or_far(matrix[3 * k : 3 * k + 3]), buckets.matrix(costs)) for k in range(3)]
                matrix = [value if value > Buckets.FAR // 2 else None for row in joined for value in row]
            else:
                now, matrix = block, buckets.matrix(costs)
        if matrix:
            yield _row(now, matrix)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Sequence[int] = buckets.start(full)
        for batch in batches:
            for block, matrix in zip(batch.column("_block").to_pylist(), batch.column("_state").to_pylist()):
                yield _row(block, state)
                state = Buckets.moved(state, [None if value is None else int(value) for value in matrix])

    def _or_far(row: Sequence[int | None]) -> list[int]:
        return [Buckets.FAR if value is None else value for value in row]

    def _row(block: int, values: Sequence[int | None]) -> pa.RecordBatch:
        columns = [pa.array([block], pa.int64()), pa.array([_decimals(values)], pa.list_(_WIDE))]
        return pa.RecordBatch.from_arrays(columns, ["_block", "_state"])

    schema = "_block long, _state array<decimal(38,0)>"
    narrow = charged.select("_block", column(order).alias("_order"), "_cost").repartition("_block")
    found = narrow.sortWithinPartitions("_block", "_order").mapInArrow(matrices, schema)
    return found.repartition(1).sortWithinPartitions("_block").mapInArrow(states, schema)


def plan_requests(
    requests: DataFrame,
    tokens_per_minute: int,
    requests_per_minute: int,
    order: str = "batch_id",
    cost: str = "cost",
    start_full: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add when each request may be sent, first come first served, to keep both limits.

    ``order`` is a number that runs through the requests without repeats.

    * ``oversize`` - the request alone exceeds the token limit and is never sent;
      it takes nothing from the budget.
    * ``earliest_us`` - when the running totals alone would allow it: exact while
      one limit binds throughout, too early otherwise, as a full allowance gains nothing by waiting.
    * ``admit_us`` - the first microsecond at which both allowances cover it, after all
      before it: what a step-by-step run of two refilling buckets gives. Both start with a
      full minute of credit, or none with ``start_full=False``.

    All is counted in whole numbers, so nothing depends on the order of adding.
    Requests are handled per block of the order; block totals and moves, one row per
    ``block_rows`` requests, are joined on their own and brought back.
    """
    buckets = Buckets(tokens_per_minute, requests_per_minute)
    amount = F.coalesce(column(cost), F.lit(0)).cast("long")
    oversize = amount > tokens_per_minute
    blocked = requests.select(
        "*",
        oversize.alias("oversize"),
        F.when(~oversize, amount).alias("_cost"),
        # Never NULL, so that both uses of ``requests`` stay the same plan.
        F.coalesce(F.floor(column(order) / block_rows).cast("long"), F.lit(0)).alias("_block"),
    )
    totals = blocked.groupBy("_block").agg(F.sum("_cost").alias("_tokens"), F.count("_cost").alias("_requests"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = ("_tokens", "_requests")
    starts = totals.select("_block", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_start") for name in sums])
    starts = starts.join(_block_states(blocked, order, buckets, start_full), "_block")
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = blocked.join(starts, "_block").select(
        "_block", "_state", "_cost", *[column(c) for c in requests.columns], "oversize",
        (F.col("_tokens_start") + F.coalesce(F.sum("_cost").over(inside), F.lit(0))).alias("cum_tokens"),
        (F.col("_requests_start") + F.count("_cost").over(inside)).alias("cum_requests"),
    )
    credit = MINUTE_US if start_full else 0
    by_totals = F.greatest(
        _over(F.col("cum_tokens"), tokens_per_minute), _over(F.col("cum_requests"), requests_per_minute)
    )
    earliest = F.when(~F.col("oversize"), F.greatest(F.lit(0), by_totals - credit).cast("long"))
    running = running.withColumn("earliest_us", earliest).sortWithinPartitions("_block", order)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for block, rows in _block_runs(batches):
            if block != now:
                now, state = block, [int(value) for value in rows.column("_state")[0].as_py()]
            times, state = buckets.admit(state, rows.column("_cost").to_pylist())
            whole = [None if time is None else -(-time // buckets.parts) for time in times]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[3:], pa.array(whole, pa.int64())], [*rows.schema.names[3:], "admit_us"]
            )

    schema = T.StructType([*running.schema.fields[3:], T.StructField("admit_us", T.LongType())])
    return running.mapInArrow(replay, schema)
