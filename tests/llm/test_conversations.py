"""Conversation repair against a plain search over all audits, and long conversations cut into blocks."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from themeloom.llm import conversations as c

ADDED = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def least_audit(rows):
    """Cost and least audit of ``(initial, fault)`` rows, letter by letter from the end."""
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    grown = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {}
    for i in range(len(rows), -1, -1):
        for added in (2, 1, 0):
            for state in range(4):
                ways = [(0, "")] if i == len(rows) and state in (0, 3) else []
                if added < 2 and (i, added + 1, grown[state]) in best:
                    cost, rest = best[i, added + 1, grown[state]]
                    ways.append((cost + 5, "I" + rest))
                if i < len(rows):
                    initial, fault = rows[i]
                    steps = [("D", 2, state)]
                    if fault not in ("blank", "duplicate"):
                        extra = 5 if fault == "truncated" else 0
                        steps.append(("R", 1 + extra, grown[state]))
                        if (state, initial) in keep:
                            steps.append(("K", extra, keep[state, initial]))
                    for letter, cost, after in steps:
                        if (i + 1, 0, after) in best:
                            more, rest = best[i + 1, 0, after]
                            ways.append((cost + more, letter + rest))
                if ways:
                    best[i, added, state] = min(ways)
    return best[0, 0, 0]


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else None
        if fault is None and kept[-1] not in ".!?":
            fault = "truncated"
        out.append(fault)
        seen.add((role, text))
    return out


def brute_conversation(rows):
    """``rows`` are (turn, role, text) without nulls but in turns, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    found = faults(rows)
    cost, audit = least_audit([(r[1][:1], f) for r, f in zip(rows, found)])
    state, lines, left = 0, [], list(rows)
    for letter in audit:
        if letter == "I":
            lines.append(ADDED[state] + ":")
        else:
            _, role, text = left.pop(0)
            if letter == "D":
                continue
            role = ADDED[state] if letter == "R" else role
            lines.append(f"{role}:{text}")
        state = {"s": 1, "u": 2, "a": 3}[lines[-1][0]]
    assert not left and re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def brute(table):
    blank = lambda v: " " if v is None else str(v)
    groups = {}
    for conv_id, turn, role, text in table:
        group = groups.setdefault(conv_id, [])
        hit = zlib.crc32(f"{blank(conv_id)}:{blank(turn)}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", blank(text)) if hit == 2 else blank(text)
        group += [(turn, "user" if hit == 4 else blank(role), text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return sorted(((k, *brute_conversation(rows)) for k, rows in groups.items()), key=repr)


def test_crossings_give_the_least_of_the_cheapest_audits():
    rng = random.Random(13)
    names = {0: None, 1: "truncated", 2: "blank", 3: "duplicate"}
    for _ in range(3000):
        codes = bytes(rng.choices(range(16), weights=[4, 4, 2, 1] + [1] * 12, k=rng.randrange(1, 14)))
        items = [c.ROW_WAYS[code] for code in codes] + [c.END_WAYS]
        states = c.crossings(items, 0, 3)
        parts = [next(w for w in ways if w[:2] == pair) for ways, pair in zip(items, zip(states, states[1:]))]
        rows = [("uas?"[code % 4], names[code // 4]) for code in codes]
        assert (sum(p[2] for p in parts), "".join(p[3] for p in parts)) == least_audit(rows)


def test_blocks_meet_as_their_rows_do():
    rng = random.Random(14)
    for _ in range(500):
        codes = bytes(rng.choices(range(16), k=rng.randrange(2, 40)))
        cuts = sorted({0, len(codes), *rng.choices(range(len(codes)), k=4)})
        runs = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        states = c.crossings([c.block_ways(run) for run in runs] + [c.END_WAYS], 0, 3)
        edits = [e for run, s, t in zip(runs, states, states[1:]) for e in c.row_edits(run, s, t)]
        whole = c.crossings([c.ROW_WAYS[code] for code in codes] + [c.END_WAYS], 0, 3)
        assert edits == c.row_edits(codes, 0, whole[-2])


@functools.cache
def odd_table():
    rng = random.Random(15)
    texts = ["Yes.", "No!", "half of it", "  ", "", None, "Why? \n", "é", "end.\t\x0b", "a:b.", "\x1f"]
    roles = ["user", "assistant", "system", "User", "", None, "u", "tool"]
    rows = []
    for conv_id in [*range(120), None]:
        for turn in range(rng.randrange(1, 12)):
            turn = rng.choice([turn, turn, turn, turn, 3, None])
            role = rng.choice(roles) if rng.random() < 0.2 else ["user", "assistant"][len(rows) % 2]
            rows.append((conv_id, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {len(rows)}."))
    # A conversation of which the damage leaves nothing.
    lost = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    return [*rows, (lost, 1, "user", "Gone."), (5, 2, "user", "long " * 200_000)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [2, 12])
def test_equals_plain_search(spark, monkeypatch, bits):
    monkeypatch.setattr(c, "BLOCK_BITS", bits)
    table = spark.createDataFrame([(*r, "x", 1) for r in odd_table()], SCHEMA + ", part string, digest int")
    got = c.repair_damaged(table.repartition(4), rows_per_range=50)
    assert got.columns == ["conv_id", *c.RESULT, "audit", "repaired_sha256"] and got.schema["conv_id"].dataType.typeName() == "long"
    assert sorted(map(tuple, got.collect()), key=repr) == brute(odd_table())


def test_one_conversation_of_all_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BITS", 5)
    rng = random.Random(16)
    rows = [("one", k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", f"B{k}.", "cut"])) for k in range(3000)]
    table = spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string"))
    blocks = c._blocks(c.materialize(table.selectExpr("*", "unhex(sha2(text, 256)) digest", "monotonically_increasing_id() row"), "rows"), 200)
    assert blocks.selectExpr("max(size(rows))").first()[0] == 32 and blocks.count() > 3000 / 32
    assert [tuple(r) for r in c.repair(table, table, rows_per_range=200).collect()] == [("one", *brute_conversation([r[1:] for r in rows]))]


def test_empty_table(spark):
    assert c.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
