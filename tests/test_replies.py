import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from themeloom.functions.replies import parse_category_list, strip_reply, validate_codes
from themeloom.operators.inference import CodeReply, ThemeReply, strip_reply_text

KNOWN = ["Price", "Staff", "Opening hours"]

# What a reply may hold in place of one answer's codes, and what is no list at all.
ITEMS = ["Price", "Storm", 7, 0.5, True, None, {"Price": 1}, [], ["Staff"], ["Storm"], ["Price", "Staff"], ["Staff", None],
         [["Price"]]]
VALUES = [list(items) for n in range(3) for items in itertools.product(ITEMS, repeat=n)]
VALUES += ["Price", 7, None, False, {"codes": ["Price"]}]
# Texts that are no JSON: cut short, run on, quoted or written otherwise.
SCRAPS = ["", "Price", '["Price"', '["Price",]', '["Price"]]', '["Price"] thanks', "['Price']", '["Price"],["Staff"]',
          '["Price"],"__end__"', "[Price]"]
REPLIES = [json.dumps(v) for v in VALUES] + [f" \n```json\n{json.dumps(v, indent=1)}\n```\n" for v in VALUES[:60]] + SCRAPS


def why(reply: str, is_multicode: bool) -> str | None:
    """The first rule a reply breaks, from the rules alone."""
    try:
        value = json.loads(reply.replace("```json", "").replace("```", "").strip())
    except ValueError:
        return "not_json"
    if not isinstance(value, list):
        return "not_a_list"
    if is_multicode and any(not isinstance(group, list) for group in value):
        return "not_a_list_of_lists"
    for group in value if is_multicode else [value]:
        if any(not isinstance(code, str) for code in group):
            return "not_a_string"
        if any(code not in KNOWN for code in group):
            return "unknown_category"
    return None


def in_task(reply: str, reader, answers: int = 1):
    """What a task makes of a reply: ``(reason, codes)``."""
    try:
        value = json.loads(strip_reply_text(reply))
    except ValueError:
        return "not_json", None
    try:
        return None, reader.read(value, answers)
    except ValueError as error:
        return str(error), None


@pytest.mark.parametrize("is_multicode", [False, True])
def test_stored_replies_and_tasks_agree(spark, is_multicode):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "i int, reply string")
    checked = validate_codes(df, "reply", KNOWN, is_multicode).orderBy("i").collect()
    reader = CodeReply(KNOWN, is_multicode)
    for row, reply in zip(checked, REPLIES):
        want = why(reply, is_multicode)
        assert (row.reason, row.valid) == (want, want is None), reply
        assert in_task(reply, reader) == (row.reason, row.codes), reply


def test_missing_reply_is_invalid(spark):
    df = spark.createDataFrame([(None,)], "reply string")
    row = validate_codes(df, "reply", KNOWN, False).first()
    assert (row.valid, row.reason, row.codes) == (False, "not_json", None)


def test_strict_length(spark):
    df = spark.createDataFrame([('["Price"]', 1), ('["Price"]', 2)], "reply string, n int")
    checked = validate_codes(df, "reply", KNOWN, False, expected="n").orderBy("n").collect()
    assert [r.reason for r in checked] == [None, "wrong_length"]
    reader = CodeReply(KNOWN, strict_length=True)
    assert [in_task('["Price"]', reader, n)[0] for n in (1, 2)] == [None, "wrong_length"]


def test_category_lists(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "i int, reply string")
    parsed = parse_category_list(df, "reply").orderBy("i").collect()
    for row, reply in zip(parsed, REPLIES):
        reason, names = in_task(reply, ThemeReply())
        assert row.valid == (reason is None), reply
        if row.valid and all(isinstance(v, str) for v in json.loads(strip_reply_text(reply))):
            assert row.categories == [n[0] for n in names]


@pytest.mark.parametrize(
    "reply, plain, fence_only",
    [
        ('```json\n["a json `b`"]\n```', '["a  b"]', '["a json `b`"]'),
        ("    [1]\x1c\n", "[1]", "[1]"),
        ("```\n[\n1]```", "[1]", "[1]"),
        ("[1]", "[1]", "[1]"),
        ("js`on", "json", "js`on"),
    ],
)
def test_strip(spark, reply, plain, fence_only):
    df = spark.createDataFrame([(reply,)], "r string")
    got = df.select(strip_reply(F.col("r")), strip_reply(F.col("r"), fence_only=True)).first()
    assert tuple(got) == (plain, fence_only)
    assert (strip_reply_text(reply), strip_reply_text(reply, fence_only=True)) == (plain, fence_only)


def test_random_replies_agree(spark):
    """Lists of codes and scraps of JSON, cut and spliced at random."""
    rng = random.Random(7)
    scraps = ["[", "]", '"Price"', '"x"', ",", ",", " ", "null", "1", "1.5", "true", "{", "}", ":", '"a":1', "```",
              "json", "\n", "\\", '"', "\t", "-0", "1e400", '"\\u0050rice"', "é", "\x0b", " "]
    names = [*KNOWN, "x"]

    def reply():
        if rng.random() < 0.5:
            return "".join(rng.choice(scraps) for _ in range(rng.randint(0, 8)))
        codes = [rng.choice(names) if rng.random() < 0.6 else rng.sample(names, rng.randint(0, 2)) for _ in range(3)]
        text = json.dumps(codes)
        at = rng.randint(0, len(text))
        return text if rng.random() < 0.6 else text[:at] + rng.choice(scraps) + text[at + rng.randint(0, 1) :]

    texts = list(dict.fromkeys(reply() for _ in range(6000)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string").repartition(8)
    for is_multicode in (False, True):
        reader = CodeReply(KNOWN, is_multicode)
        checked = validate_codes(df, "reply", KNOWN, is_multicode).collect()
        assert len(checked) == len(texts)
        for row in checked:
            assert in_task(row.reply, reader) == (row.reason, row.codes), row.reply
