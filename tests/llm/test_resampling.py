"""Importance resampling against plain Python, on odd rows and with brackets forced to shrink."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from themeloom.llm.resampling import feature_buckets, locate, resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").encode().lower())
    return len(words), [zlib.crc32(x) % 10_000 for x in words + [a + b" " + b for a, b in zip(words, words[1:])]]


def brute(documents, target, percent=25, least_words=20):
    def counts(texts):
        out = [0] * 10_000
        for text in texts:
            for bucket in features(text)[1]:
                out[bucket] += 1
        return out

    s, t = counts([x for _, x in documents]), counts(target)
    S, T = sum(s) + 10_000, sum(t) + 10_000
    gain = [math.floor(1000 * math.log((b + 1) * S / ((a + 1) * T))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in documents:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, n, len(found), weight, weight + noise))
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = able[: len(able) * percent // 100]
    return rows, [(r[4], r[0]) for r in drawn]


def test_buckets_of_odd_texts():
    rng = random.Random(3)
    for _ in range(60):
        texts = [
            rng.choice([None, "", " ", "a" * rng.choice([47, 48, 49, 400]) + " b " + "é" * rng.choice([1, 24, 25, 90]),
                        "".join(rng.choices("abcXYZ09éß .,\n\x00`{", k=rng.randrange(200)))])
            for _ in range(5)
        ]
        words, found, owner = feature_buckets([None if t is None else t.encode() for t in texts], 10_000)
        for k, text in enumerate(texts):
            n, want = features(text)
            assert words[k] == n and sorted(found[owner == k].tolist()) == sorted(want)


@pytest.fixture(scope="module")
def odd_documents():
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma", "Größe", "delta7", "ÉTÉ", "x"]
    rows = [(k, " ".join(rng.choices(words[rng.randrange(4) :], k=rng.randrange(5, 60)))) for k in range(400)]
    rows += [(k, None) for k in range(400, 405)] + [(None, rows[3][1]), (None, rows[4][1]), (405, "")]
    rows += [rows[7]] * 40 + [(406, "word " * 30_000 + "z" * 100_000)]
    return rows


def test_equals_plain_python(spark, odd_documents):
    target = ["beta gamma beta", None, "Größe x"]
    documents = spark.createDataFrame(
        [(d, t, "k0", 1) for d, t in odd_documents], "doc_id long, text string, k0 string, rank int"
    ).repartition(5)
    want_rows, want_drawn = brute(odd_documents, target)
    limits = dict(accuracy=20, most_sorted=5, rows_per_range=30)
    got = resample(documents, spark.createDataFrame([(t,) for t in target], "text string"), **limits)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = got.collect()
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want_rows, key=key)
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, len(want_drawn) + 1))
    assert [(r.score, r.doc_id) for r in drawn] == want_drawn


@pytest.mark.parametrize("percent", [0, 100])
def test_nothing_or_all(spark, odd_documents, percent):
    documents = spark.createDataFrame(odd_documents, "doc_id long, text string")
    got = resample(documents, documents.limit(0), percent=percent).collect()
    able = sum(r.n_words >= 20 for r in got)
    assert len(got) == len(odd_documents)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, able * percent // 100 + 1))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample(empty, empty).collect() == []


@pytest.mark.parametrize("distinct", [1, 3, 5000])
def test_cut_is_exact_on_ties(spark, distinct):
    """A third of all rows, or all of them, share one score, and one id."""
    rng = random.Random(distinct)
    rows = [(rng.randrange(distinct) if rng.random() < 0.6 else 0, rng.randrange(1 + distinct // 2), k) for k in range(6000)]
    table = spark.createDataFrame(rows, "k0 long, k1 long, k2 long").repartition(4).cache()
    for need in (1, 2, 2999, 5999, 6000):
        assert tuple(locate(table, need, len(rows), accuracy=50, most_sorted=20)) == sorted(rows)[need - 1]


def test_only_the_bracket_is_sorted(spark):
    rows = spark.range(50_000).select(*[F.col("id").alias(k) for k in ("k0", "k1", "k2")])
    assert locate(rows, 12_500, 50_000, accuracy=1000, most_sorted=1000) == (12_499,) * 3
