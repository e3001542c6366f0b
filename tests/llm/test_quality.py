"""Base counts against plain Python, and the classifier on planted and supplied rows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from themeloom.llm import quality
from themeloom.llm.quality import count_text, grams_of, judge_quality
from themeloom.llm.queries import op8_quality_rules
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    text = text or ""
    words = brute.words(text)
    lines = [line for line in text.split("\n") if brute.words(line)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:k] for k, line in enumerate(lines)),
        len(covered),
    )


def test_counts_of_random_texts():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b ", "\n", "é", " #", "|a b\n", "\x0b", "\x1c", " "], k=rng.randrange(60)))
        assert tuple(count_text(text.encode())) == plain_counts(text)
    assert tuple(count_text(None)) == tuple(count_text(b"")) == (0, 0, 0, 0, 0)


def test_base_counts_of_the_supplied_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op8_quality_rules(spark, "/root/testdata/sf0.001").collect():
        n = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept in (True, False) and not (r.base_failed and r.kept)


def test_labelled_rows_outside_the_sample(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = labels.where("doc_id % 3 = 1")
    found = judge_quality(documents, labels.where("doc_id % 3 != 1")).join(held, "doc_id").collect()
    good = [r for r in found if r.quality == 1 and not r.base_failed]
    bad = [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_grams_stay_within_their_text():
    texts = [b"abc abd", None, b"", b"ab", b"abc abd"]
    together = grams_of(texts)
    for k, text in enumerate(texts):
        for both, alone in zip(together, grams_of([text])):
            assert np.sort(both.bucket[both.text == k]).tolist() == np.sort(alone.bucket).tolist()


def planted(spark, n):
    rng = random.Random(n)
    rows, labels = [], []
    for k in range(n):
        words = rng.choices(["river", "stone", "house", "cloud", "green"], k=80)
        if k % 4 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(w + str(rng.randrange(50)) for w in words), "x", True))
        labels.append((k, int(k % 4 != 0), 0))
    more = [(None, "hello " * 60, "x", True), (-1, None, "x", True), (-2, "", "x", True), (5, rows[5][1], "x", True)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, quality string, kept boolean")
    return df, spark.createDataFrame(labels + [(None, 1, 0), (1, None, 0), (10**9, 0, 0)],
                                     "doc_id long, quality int, toxic int")


def test_odd_rows_and_labels(spark):
    df, labels = planted(spark, 60)
    found = judge_quality(df, labels).collect()
    assert len(found) == 64
    assert all(r.kept == (r.doc_id % 4 != 0) for r in found if r.doc_id is not None and r.doc_id >= 0 and not r.base_failed)
    assert all(r.base_failed and not r.kept for r in found if r.doc_id in (-1, -2))
    for few in (labels.limit(0), labels.where("quality = 1")):
        alone = judge_quality(df, few).collect()
        assert all(r.kept != r.base_failed and r.probability is None for r in alone)
    assert judge_quality(df.limit(0), labels).count() == 0


def test_a_labelled_id_that_repeats_brings_one_text(spark, monkeypatch):
    fitted = []
    platt = quality._platt
    monkeypatch.setattr(quality, "_platt", lambda z, target, weight: fitted.append(len(target)) or platt(z, target, weight))
    rows = [(k, f"good words number {k}" if k % 2 else f"bad noise {k} $$$") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    many = docs.union(docs.where("doc_id = 1").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("again"))
    once, again = (quality.train(some, labels, 10) for some in (docs, many))
    assert fitted == [7, 7] and np.array_equal(once.weights, again.weights)
