"""Private data against plain Python: exact base spans, and the rounds of patterns and identifiers."""

import collections
import math
import os
import random
import re

import pytest

from themeloom.llm.private_data import KINDS, find_private_data, running_sums

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text) if good(k, m[0])]


LETTERS = re.compile(r"[^\W\d_]+")


def beside(text, start, end, pieces_of):
    """Nearest words first; a candidate's words end at the next candidate, a base span's at the next match of its kind."""
    low = max([e for s, e in pieces_of if e <= start], default=0)
    high = min([s for s, e in pieces_of if s >= end], default=len(text))
    left = LETTERS.findall(text[max(low, start - 80) : start])[::-1][:2]
    return left, LETTERS.findall(text[end : min(high, end + 80)])[:2]


def patterns_of(left, right):
    out = []
    if len(left) == 2:
        out.append(("before", *left))
    if len(right) == 2:
        out.append(("after", *right))
    if left and right:
        out.append(("across", left[0], right[0]))
    return out


def brute(texts, rounds=3, trust=0.8, support=4, certain=0.95, longest=64):
    base, candidates, kind_of, edges = [], [], {}, set()
    for row, text in enumerate(texts):
        text = text or ""
        base.append(base_spans(text))
        for kind, start, end in base[-1]:
            near = beside(text, start, end, [m.span() for m in re.finditer(PATTERNS[kind], text)])
            value = text[start:end]
            kind_of[value] = min(kind, kind_of.get(value, kind))
            edges |= {(p, value) for p in patterns_of(*near)}
        tokens = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*", text)]
        for start, end in tokens:
            near = beside(text, start, end, tokens)
            inner = [k for k in range(start, end) if text[k].isalpha() or text[k].isnumeric()]
            if not inner:
                continue
            start, end = inner[0], inner[-1] + 1
            if end - start > longest or any(s < end and start < e for _, s, e in base[-1]):
                continue
            candidates.append((row, start, end, text[start:end]))
            edges |= {(p, text[start:end]) for p in patterns_of(*near)}
    found = {}
    by_pattern, by_value = collections.defaultdict(list), collections.defaultdict(list)
    for pattern, value in edges:
        by_pattern[pattern].append(value)
        by_value[value].append(pattern)
    for _ in range(rounds):
        trusted = {}
        for pattern, values in by_pattern.items():
            counts = collections.Counter(k for v in values if (k := kind_of.get(v, found.get(v))))
            if counts:
                kind = max(KINDS, key=lambda k: counts[k])
                if counts[kind] >= support and counts[kind] / (len(values) + 1) >= trust:
                    trusted[pattern] = kind, counts[kind] / (len(values) + 1)
        now = {}
        for value, patterns in by_value.items():
            votes = collections.defaultdict(float)
            for pattern in patterns:
                if value not in kind_of and pattern in trusted:
                    votes[trusted[pattern][0]] += math.log(1 - trusted[pattern][1])
            if votes and min(votes.values()) <= math.log(1 - certain) + 1e-9:
                now[value] = min(votes, key=lambda k: (votes[k], k))
        done, found = len(now) <= len(found), now
        if done:
            break
    added = [[] for _ in texts]
    for row, start, end, value in candidates:
        if value in found:
            added[row].append((found[value], start, end))
    spans = [sorted(a + b, key=lambda x: (KINDS.index(x[0]), x[1])) for a, b in zip(base, added)]
    return base, spans, found


def check(spark, texts, **options):
    table = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, kind string, row int")
    got = {r.doc_id: r for r in find_private_data(table.repartition(3), **options).collect()}
    base, spans, found = brute(texts, **options)
    written = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
    for k in range(len(texts)):
        assert got[k].base == written(base[k]), texts[k]
        assert got[k].spans == written(spans[k]), texts[k]
        assert [got[k][f"n_{kind}"] for kind in KINDS] == [sum(x[0] == kind for x in base[k]) for kind in KINDS]
        assert got[k].n_added == len(spans[k]) - len(base[k])
    assert len(got) == len(texts)
    return found


def test_base_spans_of_random_texts(spark):
    rng = random.Random(11)
    pieces = ["a@b.c", "x", ".", "@", "+1", " ", "-", "(", ")", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "256", "0001",
              "9", "55", "é", "😀", "\n", "+44 20 7946 0958", "me_", "%", "b-1.co", "\t", "\x0b", "1.2.3.4.5", "_x@d.e"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(500)]
    check(spark, [*texts, None, "", *texts[:5]], support=1, trust=0.3, certain=0.3)


def planted():
    """Seeds and unseen identifiers behind the same words, and clean numbers behind others."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(5, 30)))
    texts = []
    for k in range(60):
        texts.append(f"{prose()} write to me at user{k}@mail{k % 7}.org or visit {prose()}")
        texts.append(f"{prose()}\nYour phone line: +1 (555) 555-{1000 + k} by day {prose()}")
        texts.append(f"{prose()} Apache License, Version {k % 9}.0. {prose()}")
    for k in range(5):
        texts.append(f"{prose()} write to me at user{k}(at)mail{k}.org or visit {prose()}")
        texts.append(f"{prose()} phone line: 555-77{k}0 by day {prose()}")
        # Reached over an identifier found in the first round only.
        texts += [f"{prose()} only {word()} is user{k}(at)mail{k}.org instead of {prose()}"] * 2
    return [*texts, *texts[:40]]


def test_unseen_identifiers_are_found_and_numbers_are_left(spark):
    texts = planted()
    found = check(spark, texts)
    assert {v for v in found if "(at)" in v} == {f"user{k}(at)mail{k}.org" for k in range(5)}
    assert {v for v in found if v.startswith("555")} == {f"555-77{k}0" for k in range(5)}
    assert len(found) == 10


def test_texts_of_any_length(spark):
    """Each of these takes minutes, or the stack, where a pattern looks at a run more than once."""
    host = ".c" * 100_000
    texts = ["a" * 1_000_000, "1" * 300_000, "1 " * 100_000, "a@b" + host, "a@" * 100_000, "+" * 100_000, "+1" + "(" * 200_000,
             "1.2.3.4 " * 5_000, "0" * 200_000 + ".1.1.1", "x1" + "#" * 300_000 + "y"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.base for r in find_private_data(table).collect()}
    want = {3: f"email:0:{len(host) + 3}", 7: ",".join(f"ip:{8 * k}:{8 * k + 7}" for k in range(5000)), 8: "ip:0:200006"}
    assert got == {k: want.get(k, "") for k in range(len(texts))}


def test_running_sums_of_long_arrays(spark):
    sizes = [[], [5], list(range(700)), [1] * 512, [2] * 257]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(sizes)], "k int, xs array<long>")
    for row in running_sums(df, "xs").collect():
        assert row.xs == [sum(sizes[row.k][: n + 1]) for n in range(len(sizes[row.k]))]


def test_empty_table(spark):
    assert find_private_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="supplied tables are not there")
def test_supplied_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [r.text for r in documents.orderBy("doc_id").collect()])


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = find_private_data(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
