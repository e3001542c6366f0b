"""Languages: held-out accuracy, Viterbi against all paths, odd texts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm.language import Words, best_path, identify_languages
from themeloom.llm.queries import op7_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op7_language_id(spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_best_path_is_the_best_of_all():
    rng = np.random.default_rng(1)
    doc = np.repeat([0, 2, 3, 7], [1, 6, 3, 5])
    scores = -rng.random((len(doc), 3)).astype(np.float32) * 4
    path = best_path(scores, doc, 1.5)
    for d in set(doc):
        own = np.flatnonzero(doc == d)

        def value(states):
            return sum(scores[k, s] for k, s in zip(own, states)) - 1.5 * sum(a != b for a, b in itertools.pairwise(states))

        best = max(value(states) for states in itertools.product(range(3), repeat=len(own)))
        assert value(path[own]) == pytest.approx(best, abs=1e-5)


def test_words_and_their_places():
    texts = ["Ab é1Ñ", None, "", "x", "12 !", "\U00020000a"]
    words = Words([t if t is None else t.encode() for t in texts])
    found = list(zip(words.doc.tolist(), words.start.tolist(), words.letters.tolist()))
    assert found == [(0, 0, 2), (0, 3, 1), (0, 5, 1), (3, 0, 1), (5, 0, 2)]
    apart = [Words([t.encode()]).buckets.tolist() for t in ("Ab é1Ñ", "x", "\U00020000a")]
    assert words.buckets.tolist() == list(itertools.chain.from_iterable(apart))
    assert Words(["ÀB".encode()]).buckets.tolist() == Words(["àb".encode()]).buckets.tolist()


LINES = {
    "en": "the quick brown fox jumps over the lazy dog while all the other animals watch and wonder why",
    "ru": "съешь же ещё этих мягких французских булок да выпей чаю и подумай о том что было вчера",
    "de": "der schnelle braune fuchs springt über den faulen hund und alle anderen tiere schauen zu",
}


def training(spark):
    rows = [(k, text, lang) for k, (lang, text) in enumerate(LINES.items())]
    rows += [(10, None, "en"), (11, "text", None), (None, "nothing", "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_spans_of_mixed_text(spark):
    text = LINES["en"] + ". " + LINES["ru"] + "! " + LINES["de"]
    rows = [(1, text, "k"), (2, "чаю", "k"), (3, "αβγ δε", "k"), (4, None, "k"), (5, " 12 - !", "k"), (6, "", "k"),
            (None, LINES["de"], "k"), (1, text, "k"), (7, (LINES["en"] + " ") * 3000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    found = {r.doc_id: r for r in identify_languages(df, training(spark)).collect()}
    spans = [(s.lang, text[s.start : s.end]) for s in found[1].spans]
    assert spans == [("en", LINES["en"]), ("ru", LINES["ru"]), ("de", LINES["de"])]
    assert found[2].lang_pred == "ru" and found[None].lang_pred == "de" and found[7].lang_pred == "en"
    assert found[3].lang_pred in LINES
    for k in (4, 5, 6):
        assert (found[k].lang_pred, found[k].score, found[k].spans) == ("und", 0.0, [])
    assert identify_languages(df, training(spark)).count() == len(rows)
    assert identify_languages(df.limit(0), training(spark)).count() == 0
    alone = identify_languages(df, training(spark).limit(0))
    assert {r.lang_pred for r in alone.select("lang_pred").distinct().collect()} == {"und"}


def test_same_sample_in_any_partitioning(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = identify_languages(df, df, rows_per_language=20)
    other = identify_languages(df.repartition(5), df.repartition(7), rows_per_language=20)
    key = F.struct("doc_id", "lang_pred", "score")
    assert sorted(one.select(key).collect()) == sorted(other.select(key).collect())
