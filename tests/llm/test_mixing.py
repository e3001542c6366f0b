"""Mixing: raking against its targets, and the draws against plain arithmetic."""

import numpy as np
import pytest
import xxhash

from themeloom.llm.mixing import TARGETS, TOPICS, attained_shares, draw_documents, mixed_documents, mixing_table
from themeloom.llm.mixing import cells_of, probabilities, rake
from themeloom.llm.queries import op5_mix_sources
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_raking_meets_every_margin_and_keeps_the_odds():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 1000, (4, 3, 5)).astype(float)
    shares = [rng.dirichlet(np.ones(n)) for n in tokens.shape]
    fitted = rake(tokens, shares)
    for axis, share in enumerate(shares):
        assert fitted.sum(axis=tuple(a for a in range(3) if a != axis)) == pytest.approx(share, abs=1e-8)
    odds = fitted / tokens
    cross = odds[0, 0, 0] * odds[1, 1, 0] / (odds[0, 1, 0] * odds[1, 0, 0])
    assert cross == pytest.approx(1.0)
    tokens[2] = 0
    left = shares[0] * [1, 1, 0, 1] / (1 - shares[0][2])
    assert rake(tokens, shares).sum(axis=(1, 2)) == pytest.approx(left, abs=1e-8)
    assert not rake(np.zeros((2, 2)), [np.ones(2) / 2] * 2).any()


def test_probabilities_spend_the_budget():
    rng = np.random.default_rng(4)
    for budget in (0.1, 0.6, 0.95, 1.0, 2.0):
        tokens = rng.integers(0, 1000, (6, 4)).astype(float)
        fitted = rng.dirichlet(np.ones(24)).reshape(6, 4) * (tokens > 0)
        chance = probabilities(tokens, fitted, budget)
        assert ((0 <= chance) & (chance <= 1)).all()
        assert (chance * tokens).sum() == pytest.approx(min(budget, 1.0) * tokens.sum())
    assert not probabilities(np.zeros((2, 2)), np.zeros((2, 2)), 0.5).any()


def topic(text):
    votes = [0] * TOPICS
    for word in brute.words((text or "").translate(brute.LOWER)):
        votes[xxhash.xxh3_64_intdigest(word.encode()) % TOPICS] += 1
    return str(votes.index(max(votes)))


def test_supplied_documents(spark):
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_mix_sources(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.tokens, r.topic) == (len(brute.words(texts[r.doc_id].text)), topic(texts[r.doc_id].text))
    total = sum(r.tokens for r in rows)
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(0.7 * total)
    # Among documents that are not certain, the weights stand as the targets do.
    weighted = {}
    for r in rows:
        weighted[r.lang] = weighted.get(r.lang, 0) + r.tokens * r.weight / total
    assert weighted == pytest.approx({"en": 0.54 / 0.99, "de": 0.17 / 0.99, "fr": 0.16 / 0.99, "es": 0.12 / 0.99})
    drawn = sum(r.tokens for r in rows if r.kept)
    assert abs(drawn - 0.7 * total) < 0.1 * total


def test_odd_rows(spark):
    rows = [(1, "a b c", "src0", "en"), (2, None, "src0", "en"), (3, "", None, None), (None, "d e", "new", "xx"),
            (4, "w " * 30000, "src1", "de"), (4, "w " * 30000, "src1", "de")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, topic int")
    found = draw_documents(df, budget=1.0).collect()
    assert len(found) == 6 and all(r.kept for r in found if r.tokens)
    assert len({(r.kept, r.probability) for r in found if r.doc_id == 4}) == 1
    kept = mixed_documents(df, budget=0.4).collect()
    chosen = [r for r in draw_documents(df, budget=0.4).collect() if r.kept]
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in chosen)
    assert draw_documents(df.limit(0)).count() == mixed_documents(df.limit(0)).count() == 0
    assert mixing_table(cells_of(df.limit(0))) == []


def test_copies_hold_the_targets_and_the_budget(spark):
    rows = op5_mix_sources(spark, SF).collect()
    total = sum(r.tokens for r in rows)
    report = {(d, v): (target, *shares) for d, v, target, *shares in attained_shares(spark.read.parquet(f"{SF}/documents.parquet"))}
    assert sum(r.tokens * r.expected_copies for r in rows) == pytest.approx(0.7 * total)
    assert sum(r.tokens * r.copies for r in rows) == pytest.approx(0.7 * total, rel=0.1)
    assert any(r.expected_copies > 1 for r in rows)
    for dimension, targets in TARGETS.items():
        # No document has another language, so the four share the whole.
        present = sum(targets.values()) if dimension == "lang" else 1.0
        for value, target in targets.items():
            expected = sum(r.tokens * r.expected_copies for r in rows if r[dimension] == value) / (0.7 * total)
            once = sum(r.tokens * r.probability for r in rows if r[dimension] == value) / (0.7 * total)
            assert expected == pytest.approx(target / present, abs=1e-6)
            assert report[dimension, value][::2] == pytest.approx((target, expected), abs=1e-6)
            assert report[dimension, value][3] == pytest.approx(once, abs=1e-6)
    for r in rows:
        assert int(r.expected_copies) <= r.copies <= int(r.expected_copies) + 1


def test_repeated_rows_are_the_copies(spark):
    rows = [(k, "a b c " * 5, "src0" if k < 3 else "src1", "en") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    copies = {r.doc_id: r.copies for r in draw_documents(df).collect() if r.copies}
    found = [r.doc_id for r in mixed_documents(df, repeats=True).collect()]
    assert {d: found.count(d) for d in found} == copies and max(copies.values()) > 1
