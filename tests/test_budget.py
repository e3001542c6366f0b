import random
from fractions import Fraction

import pytest

from themeloom.operators.budget import Buckets, plan_requests


def plan(spark, costs, tokens, requests, **options):
    df = spark.createDataFrame(list(enumerate(costs)), "batch_id long, cost long")
    return plan_requests(df, tokens, requests, **options).orderBy("batch_id").collect()


def test_the_first_minute_is_free_then_the_limit_holds(spark):
    rows = plan(spark, [50, 50, 50], tokens=100, requests=1000)
    assert [r.admit_us for r in rows] == [0, 0, 30_000_000]
    assert [r.cum_tokens for r in rows] == [50, 100, 150]
    rows = plan(spark, [1] * 5, tokens=1000, requests=2)
    assert [r.admit_us / 1e6 for r in rows] == [0, 0, 30, 60, 90]


def test_without_credit_every_request_waits(spark):
    rows = plan(spark, [50, 50], tokens=100, requests=1000, start_full=False)
    assert [r.admit_us / 1e6 for r in rows] == [30, 60]


def test_oversize_is_refused_and_free(spark):
    rows = plan(spark, [150, 60, 60], tokens=100, requests=1000)
    assert [r.oversize for r in rows] == [True, False, False]
    assert [r.admit_us for r in rows] == [None, 0, 12_000_000]
    assert rows[0].cum_tokens == rows[0].cum_requests == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_never_overdraws_either_limit(spark, seed):
    """Replay against two refilling allowances that are capped at one minute."""
    rng = random.Random(seed)
    costs = [rng.randint(1, 30) for _ in range(150)] + [rng.randint(100, 600) for _ in range(150)]
    tokens, requests = 3_000, 40
    rows = plan(spark, costs, tokens, requests, block_rows=37)
    times = [r.admit_us / 1e6 for r in rows]
    assert times == sorted(times)
    left, last = {"tokens": tokens, "requests": requests}, 0.0
    for row, at in zip(rows, times):
        for name, limit, used in (("tokens", tokens, row.cost), ("requests", requests, 1)):
            left[name] = min(limit, left[name] + (at - last) * limit / 60) - used
            assert left[name] >= -1e-6
        last = at
        assert row.earliest_us <= row.admit_us


def test_large_totals_stay_exact(spark):
    """Totals whose product with a minute of microseconds passes 64 bits."""
    limit = 10**8
    costs = [limit - 7] * 2000
    rows = plan(spark, costs, tokens=limit, requests=10**6, block_rows=300)
    want = [max(0, -(-(i + 1) * (limit - 7) * 60_000_000 // limit) - 60_000_000) for i in range(2000)]
    assert [r.earliest_us for r in rows] == want


def replay(costs, tokens, requests, full):
    """Two buckets run step by step in exact seconds; whole microseconds, rounded up."""
    held = {"tokens": Fraction(tokens if full else 0), "requests": Fraction(requests if full else 0)}
    now, times = Fraction(0), []
    for cost in costs:
        if cost > tokens:
            times.append(None)
            continue
        needs = {"tokens": (cost, tokens), "requests": (1, requests)}
        wait = max(Fraction(0), *[(need - held[name]) * 60 / limit for name, (need, limit) in needs.items()])
        now += wait
        for name, (need, limit) in needs.items():
            held[name] = min(Fraction(limit), held[name] + wait * limit / 60) - need
        times.append(-((-now * 1_000_000) // 1))
    return times


@pytest.mark.parametrize("tokens, requests", [(3_000, 40), (9_973, 101), (140_000, 450), (100, 1)])
@pytest.mark.parametrize("full", [True, False])
def test_plan_is_that_of_two_buckets(spark, tokens, requests, full):
    """The limit that binds changes several times, and a full bucket loses what it could have gained."""
    rng = random.Random(tokens)
    mean = tokens // requests
    costs = [rng.randint(0, max(1, int(mean * share * 2))) for share in (0.1, 3, 0.2, 1, 0.05, 5) for _ in range(60)]
    costs[100] = costs[250] = tokens + 1
    rows = plan(spark, costs, tokens, requests, start_full=full, block_rows=29)
    want = replay(costs, tokens, requests, full)
    assert [r.admit_us for r in rows] == want
    assert all(r.earliest_us <= r.admit_us for r in rows if not r.oversize)
    if full and tokens == 3_000:
        assert any(r.earliest_us < r.admit_us for r in rows if not r.oversize)


def test_runs_of_requests_join_in_any_grouping():
    rng = random.Random(1)
    buckets = Buckets(9_973, 101)
    for _ in range(200):
        costs = [rng.choice([None, rng.randint(0, 9_973)]) for _ in range(rng.randint(2, 30))]
        cut = rng.randrange(1, len(costs))
        state = tuple(rng.randrange(buckets.minute) for _ in range(3))
        _, direct = buckets.admit(state, costs)
        step = Buckets.moved(Buckets.moved(state, buckets.matrix(costs[:cut])), buckets.matrix(costs[cut:]))
        assert step == direct == Buckets.moved(state, buckets.matrix(costs))


def test_plan_keeps_other_columns(spark):
    df = spark.createDataFrame([(2, 5, "b", None), (1, None, "a", [1])], "batch_id long, cost int, prompt string, xs array<int>")
    rows = plan_requests(df, 10, 10).orderBy("batch_id").collect()
    assert [(r.batch_id, r.cost, r.prompt, r.xs, r.admit_us) for r in rows] == [(1, None, "a", [1], 0), (2, 5, "b", None, 0)]
