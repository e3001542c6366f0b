"""Near duplicates against all pairs by brute force."""

import random

import numpy as np
import pytest

from themeloom.llm import minhash
from themeloom.llm.graph import connected_components
from themeloom.llm.minhash import Shingler, chunk_keys, first_documents, near_duplicates, signature, similar, tile_links
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)]
    links += [(5000, 5001 + k) for k in range(200)] + [(7, 7), (9, None)]
    found = connected_components(spark.createDataFrame(links, "a long, b long"))
    real = [(a, b) for a, b in links if b is not None and a != b]
    nodes = {n for link in real for n in link}
    assert {(r.node, r.component) for r in found.collect()} == set(brute.components(nodes, real).items())
    assert found.count() == len(nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_are_exact():
    texts = ["", None, "One", "a b", "A b a B", "x\x1cy z\tz z\x0bz", "é É é É"]
    sets = Shingler().sets([t if t is None else t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]
    assert (sets[3][0] in sets[4]) and len(set(sets[2]) & set(sets[3])) == 0


def test_all_pairs_up_to_the_guaranteed_distance_share_a_key():
    rng = np.random.default_rng(2)
    most = minhash.HASHES // minhash.CHUNK * (minhash.ERRORS + 1) - 1
    base = rng.integers(0, 2**16, minhash.HASHES).astype("<u2")
    for _ in range(300):
        other = base.copy()
        places = rng.choice(minhash.HASHES, most, replace=False)
        other[places] += rng.integers(1, 2**16, most).astype("<u2")
        keys = chunk_keys(np.stack([base, other]))
        assert (keys[0] == keys[1]).any()


def test_similarity_is_exact_at_the_edge():
    a = np.arange(100, dtype=np.uint64)
    assert similar(a, a[:80], 80) and not similar(a, a[:79], 80)
    assert similar(a[:9], np.arange(1, 10, dtype=np.uint64), 80)  # 8 of 10
    assert not similar(a[:4], np.arange(1, 5, dtype=np.uint64), 80)


def near_copies(rng, n_groups, n_copies, n_words):
    rows = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
        for _ in range(n_copies):
            copy = list(base)
            for _ in range(rng.randrange(n_words // 6)):
                copy[rng.randrange(n_words)] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_groups_of_near_copies(spark, monkeypatch, block_rows):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block_rows)
    rows = near_copies(random.Random(4), 6, 70, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(near_duplicates(df, words=2)) == brute.near_duplicates(rows)


def test_odd_rows(spark):
    rows = [
        (1, "a b c d e f"), (2, "A  b\tc d E f"), (3, ""), (4, None), (5, "  "), (6, "solo"), (7, "SOLO"), (8, "a b"),
        (9, "é"), (10, "É"), (11, "x " * 20000), (12, "y x " * 30000),
    ]
    more = [(n, t, "k", t) for n, t in rows] + [(None, "a b c d e f", "k", None), (None, None, "k", "a")]
    df = spark.createDataFrame(more, "doc_id long, text string, key string, set_id string")
    found = near_duplicates(df, words=2).collect()
    assert sorted(tuple(r) for r in found if r.doc_id is not None) == brute.near_duplicates(rows)
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is None) == [
        (0, None, True), (5, None, True),
    ]
    assert near_duplicates(df.limit(0), words=2).count() == 0


def test_rows_with_one_id_are_one_document(spark):
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "k l m n o"), (8, "k l m n o"), (8, "k l m n o"), (9, "q r s")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
    assert result(found) == [(1, 4, 1, True), (5, 4, 1, False), (5, 4, 1, False), (8, 4, 1, False), (8, 4, 1, False),
                             (9, 2, 9, True)]


def test_supplied_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(near_duplicates(df, words=2)) == brute.near_duplicates([(r.doc_id, r.text) for r in df.collect()])


def test_tile_links_span_the_links():
    sets = [np.arange(k, 100 + k, dtype=np.uint64) for k in range(0, 60, 5)]
    links = tile_links(
        list(range(12)), np.zeros(12), list(range(12)), np.stack([signature(s) for s in sets]), sets, 80
    )
    assert len(links) == 11


def test_rows_that_repeat_with_one_id_are_one(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (1, "other words here", "x"), (2, "A b c", "x"), (3, None, "x"),
            (3, None, "x"), (3, "", "x"), (None, "a b c", "x"), (None, "a b c", "x")]
    found = first_documents(spark.createDataFrame(rows, "doc_id long, text string, `o.k` string"))
    assert found.columns == ["doc_id", "text", "o.k"]
    want = [rows[0], rows[2], rows[4], rows[6], rows[7], rows[8]]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_shingles_of_five_words(spark):
    rows = near_copies(random.Random(8), 4, 12, 150) + [(900, "a b c"), (901, "A b C"), (902, "a b c d e f"), (903, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(near_duplicates(df)) == brute.near_duplicates(rows, words=5)


def test_first_documents_keep_their_columns(spark):
    rows = [(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (None, "a b c d e f", "z"), (None, None, "z"), (7, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dropped_id string")
    assert set(map(tuple, first_documents(df).collect())) == set(rows[1:])
    assert first_documents(df).columns == df.columns


def test_known_groups_are_not_confirmed_again():
    sets = [np.arange(k, 100 + k, dtype=np.uint64) for k in range(0, 60, 5)]
    signatures = np.stack([signature(s) for s in sets])
    groups = [0] * 6 + [1] * 6
    assert len(tile_links(list(range(12)), np.zeros(12), groups, signatures, sets, 80)) == 1


def test_chains_of_copies_over_many_blocks(spark, monkeypatch):
    """Each text is like its neighbours only, so no hub joins the group."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    words = [f"w{k}" for k in range(1200)]
    rows = [(k, " ".join(words[10 * k : 10 * k + 100])) for k in range(90)]
    rows += [(200 + k, " ".join(words[600 + 40 * k : 700 + 40 * k])) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(near_duplicates(df, words=2)) == brute.near_duplicates(rows)
