"""The stages one after another, each against what it must do to its own input."""

from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from themeloom.llm.mixing import BUDGET, TARGETS, attained_shares, draw_documents
from themeloom.llm.queries import op8_quality_rules
from themeloom.llm.tokens import END_ID, tokenizer_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs.collect())
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    raw, good, single, cut, mixed = ({r.doc_id: r for r in rows} for rows in seen)
    assert all(len(rows) == len({r.doc_id for r in rows}) for rows in seen[:4])
    kept = {r.doc_id for r in op8_quality_rules(spark, SF).collect() if r.kept}
    assert set(good) == kept and all(good[k] == raw[k] for k in good)
    near = brute.near_duplicates([(r.doc_id, r.text) for r in good.values()], words=5)
    assert set(single) == {d for d, _, _, first in near if first} and all(single[k] == good[k] for k in single)
    assert len({r.text for r in single.values()}) == len(single)
    want = brute.remove_repeats([(r.doc_id, r.text) for r in single.values()], 50)
    assert {d: kept.decode(errors="ignore") for d, *_, kept in want} == {d: r.text for d, r in cut.items()}
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (raw[d].lang, raw[d].source) for d, r in cut.items())
    # The mix repeats rows as often as the targets need, and its tokens hold the targets.
    assert all(mixed[k] == cut[k] for k in mixed)
    before = spark.read.parquet(f"{tmp_path}/repeat_dedup")
    drawn = {r.doc_id: r for r in draw_documents(before).collect()}
    copies = Counter(r.doc_id for r in seen[4])
    assert copies == {d: r.copies for d, r in drawn.items() if r.copies} and max(copies.values()) > 1
    budget = BUDGET * sum(r.tokens for r in drawn.values())
    off = {name: [0.0, 0.0, 0.0] for name in TARGETS}
    report = attained_shares(before)
    for dimension, value, target, *shares in report:
        rows = [r for r in drawn.values() if (r[dimension] if r[dimension] in TARGETS[dimension] else "other") == value]
        mine = sum(r.tokens * r.expected_copies for r in rows) / budget
        assert abs(sum(r.tokens * copies[r.doc_id] for r in rows) / budget - mine) < 0.05
        present = sum(t for d, _, t, had, *_ in report if d == dimension and had)
        want = target / present if shares[0] else 0.0
        for k, share in enumerate((mine, shares[2], shares[0])):
            off[dimension][k] += abs(share - want)
    # Topics are fitted last and hold exactly; so few documents may not hold all three at once.
    assert off["topic"][0] < 1e-6
    assert all(mixed_off < once_off and mixed_off < as_given for mixed_off, once_off, as_given in off.values())
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = {}
    for r in docs.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert set(pieces) == set(mixed)
    for d, parts in pieces.items():
        ids = tokenizer.encode(mixed[d].text, add_special_tokens=False).ids + [END_ID]
        times = Counter()
        for start, part in parts:
            assert part == ids[start : start + len(part)]
            times.update(range(start, start + len(part)))
        assert times == dict.fromkeys(range(len(ids)), copies[d])


def test_stages_on_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(1, None, "en", "src0", None, "a"), (None, "words " * 3, None, None, 9, "b"), (2, "", "en", "src0", 0, "c")]
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (rows + rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, str(tmp_path))
            if name == "repeat_dedup":
                assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, some))
            assert out.count() <= 2 * len(some)
        assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() == 0
