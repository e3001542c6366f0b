"""Packing against whole-text encoding, exact round trips and brute-force subset sums."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from themeloom.llm.best_fit import _matrix_task, RoomTree, pack_matrix
from themeloom.llm.packing import Piece, _pack_task, closest_fill, cut_rest, fill_windows, pack_documents
from themeloom.llm.queries import op1_pack_min_slack
from themeloom.llm.tokens import END_ID, WordEncoder, tokenizer_path

ODD_TEXTS = [
    None, "", " ", "\t\n", "0 10 a0b 0", "It's we'll 'S x's, y.,", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b.",
    "ÉTÉ ﬁne İx ΣΑΣ. ét́  x y z", "日本語 テスト, 漢字.", "a,b.c..., ... ,", "x" * 5000,
    "word " * 9000, "a\x1cb \x00 c", "🙂🙂, 🙂.", "1,000.5 3.", "foo., bar,. A,",
]


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_words_apart_equal_whole_texts(tokenizer):
    rng = random.Random(3)
    alphabet = list("aAbeE.,'0 1  \n\té|<>-") + ["'s", "<|endoftext|>", "ß", "Σ", "́", " ", "the "]
    texts = ODD_TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(600)]
    ids, begins = WordEncoder(tokenizer_path()).encode([t if t is None else t.encode() for t in texts], END_ID)
    for k, text in enumerate(texts):
        assert ids[begins[k] : begins[k + 1]].tolist() == whole(tokenizer, text), repr(text)


def test_closest_fill_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(200):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(8))]
        room = rng.randrange(60)
        counts = {n: items.count(n) for n in items}
        taken = closest_fill(counts, room)
        assert all(0 < n <= counts[length] for length, n in taken.items())
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        assert sum(length * n for length, n in taken.items()) == best


def test_windows_hold_every_piece_once():
    rng = random.Random(7)
    pieces = [Piece(k, 0, 0, np.full(rng.randrange(1, 64), k, dtype=np.uint32)) for k in range(300)]
    waiting = {}
    for piece in pieces:
        waiting.setdefault(len(piece.ids), []).append(piece)
    filled, rest = fill_windows(waiting, 64)
    assert all(sum(len(p.ids) for p in window) == 64 for window in filled)
    tail = cut_rest(rest, 64)
    sizes = [sum(len(p.ids) for p in window) for window in tail]
    assert all(n & (n - 1) == 0 for n in sizes) and sum(n < 64 for n in sizes) <= 6
    seen = np.concatenate([p.ids for window in filled + tail for p in window])
    assert sorted(seen.tolist()) == sorted(np.concatenate([p.ids for p in pieces]).tolist())


def documents(spark, texts):
    rows = [(k if k != 4 else None, text, "en", k) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


@pytest.mark.parametrize("window", [16, 4096])
def test_pieces_rebuild_all_documents(spark, tokenizer, window):
    df = documents(spark, ODD_TEXTS + ODD_TEXTS).repartition(3)
    rows = pack_documents(df, window=window, chunk_bytes=20_000).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, text in enumerate(ODD_TEXTS + ODD_TEXTS):
        if k == 4:
            continue
        want = np.array(whole(tokenizer, text), dtype="<u4").tobytes()
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == want
        assert [r.start for r in pieces] == list(itertools.accumulate([0] + [r.length for r in pieces]))[:-1]
        assert all(r.doc_tokens * 4 == len(want) for r in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = 0
        for r in pieces:
            assert r.offset == total
            total += r.length
        assert total <= window and total & (total - 1) == 0
    assert len(by_doc[None]) >= 1


def test_no_documents_give_no_pieces(spark):
    assert pack_documents(documents(spark, [])).count() == 0
    assert pack_matrix(documents(spark, [])).count() == 0


def test_query_covers_the_table(spark, tokenizer):
    rows = op1_pack_min_slack(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = np.array(whole(tokenizer, texts[r.doc_id]), dtype="<u4")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum(len(whole(tokenizer, t)) for t in texts.values())


def test_room_tree_finds_the_tightest_window():
    rng = random.Random(11)
    tree, rooms = RoomTree(64), []
    for _ in range(500):
        if rng.random() < 0.5:
            room = rng.randrange(65)
            tree.add(room, [])
            rooms.append(room)
        else:
            least = rng.randrange(65)
            fits = [r for r in rooms if r >= least]
            found = tree.take(least)
            assert (found[0] if found else None) == (min(fits) if fits else None)
            if fits:
                rooms.remove(min(fits))


@pytest.mark.parametrize("window", [16, 4096])
def test_matrix_rebuilds_all_documents(spark, tokenizer, window):
    df = documents(spark, ODD_TEXTS).repartition(2)
    rows = pack_matrix(df, window=window, pad_id=7, chunk_bytes=20_000).collect()
    parts = {}
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == window and r.cu_seqlens[-1] == r.n_tokens <= window
        assert (ids[r.n_tokens :] == 7).all() and not positions[r.n_tokens :].any()
        for doc_id, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc_id, []).append((start, ids[a:b].tolist()))
    for k, text in enumerate(ODD_TEXTS):
        if k != 4:
            assert [i for _, ids in sorted(parts[k]) for i in ids] == whole(tokenizer, text)


@pytest.mark.parametrize("pack", [_pack_task, _matrix_task])
def test_what_waits_is_bounded_by_windows(pack, monkeypatch):
    """Equal documents of a little over half a window never fill one; few of them may wait."""
    monkeypatch.setattr("themeloom.llm.packing.HELD_WINDOWS", 8)
    monkeypatch.setattr("themeloom.llm.best_fit.HELD_WINDOWS", 8)
    text = " ".join(["the"] * 40)
    held = []

    def batches():
        for k in range(20):
            ids = pa.array(range(100 * k, 100 * k + 100), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([text] * 100)], ["doc_id", "text"])

    options = (64, 1 << 20) if pack is _pack_task else (0, 64, 1 << 20)
    given = 0
    for k, batch in enumerate(pack(batches(), tokenizer_path(), END_ID, *options)):
        tokens = batch.column("length") if pack is _pack_task else batch.column("n_tokens")
        given += sum(tokens.to_pylist())
        held.append(given)
    assert given == 20 * 100 * 41 and len(held) >= 20
