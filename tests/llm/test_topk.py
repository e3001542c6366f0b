"""Top-k against a full sort of all scores."""

import math
import random

import pytest

from themeloom.llm import topk
from themeloom.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>, score int, query_hash string"


def brute(queries, candidates, k):
    def whole(rows):
        ok = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
        return [(i, [math.floor(256 * x) for x in v]) for i, v in ok]

    out = []
    for q, v in {(i, tuple(v)) for i, v in whole(queries) if i is not None}:
        scored = [(-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), i is None, i or 0, i)
                  for i, w in whole(candidates) if i != q and len(w) == len(v)]
        out += [(q, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, queries, candidates, k):
    def frame(rows):
        return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)

    return sorted((tuple(r) for r in top_k(frame(queries), frame(candidates), k).collect()), key=repr)


@pytest.mark.parametrize("tile", [4096, 7])
def test_against_all_scores(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE_ROWS", tile)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    rng = random.Random(6)
    rows = [(k, [rng.choice([-1.0, -0.3, 0.0, 0.004, 0.7]) for _ in range(3)]) for k in range(150)]
    queries = rows[::10]
    assert run(spark, queries, rows, 4) == brute(queries, rows, 4)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, []),
            (8, []), (None, [0.5, 0.5]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (10, [1e9, -1e9]), (11, [3e17, 1e17]),
            (12, [0.1, 0.2, 0.3]), (1, [0.25, 0.5])]
    assert run(spark, rows, rows, 3) == brute(rows, rows, 3)
    assert run(spark, [], rows, 3) == run(spark, rows, [], 3) == []
