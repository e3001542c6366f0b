"""The same results in SQL, for DuckDB on the supplied tables."""

from __future__ import annotations

from catalog.tables import (
    CELLS,
    LINES,
    NOTE_CATEGORIES,
    NOTES,
    PART_CATEGORIES,
    PART_CODES,
    PARTS,
    QUESTION,
    REPLIES,
)
from themeloom.config import DEFAULT_CATEGORIES

NOTE_PROMPTABLE = [c for c in NOTE_CATEGORIES if c != "Uncategorized"]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def clean(expression: str) -> str:
    spaced = rf"regexp_replace(lower({expression}), '\s+', ' ', 'g')"
    return f"trim(regexp_replace({spaced}, '[^a-z0-9 ]', '', 'g'))"


def with_tables(*steps: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in steps) + "\n"


def cleaned(source: str) -> tuple[str, str]:
    return ("cleaned", f"SELECT id, {clean('r1')} AS r1, {clean('r2')} AS r2 FROM ({source}) AS raw")


NOTE_ROWS = cleaned(NOTES.format(documents="documents"))
PART_ROWS = cleaned(PARTS.format(part="part"))
LINE_ROWS = cleaned(LINES.format(lineitem="lineitem"))
LONG = (
    "long",
    "SELECT id, 'r1' AS response_column, r1 AS response FROM cleaned WHERE r1 IS NOT NULL "
    "UNION ALL SELECT id, 'r2', r2 FROM cleaned WHERE r2 IS NOT NULL",
)
DISTINCT = ("answers_all", "SELECT DISTINCT response FROM long")
ANSWERS = ("answers", "SELECT response FROM answers_all WHERE response <> ''")
SAMPLE = (
    "sample",
    "SELECT response, row_number() OVER (ORDER BY md5(concat('7', response)), response) AS place "
    "FROM answers_all QUALIFY place <= 100",
)
PLACED = (
    "placed",
    "SELECT response, row_number() OVER (ORDER BY md5(response), response) - 1 AS place FROM answers",
)
MEMBERS = ("members", "SELECT response, place // 3 AS batch_id, place % 3 AS i FROM placed")
NOTE_ANSWERS = (NOTE_ROWS, LONG, DISTINCT, ANSWERS)
PART_ANSWERS = (PART_ROWS, LONG, DISTINCT, ANSWERS)
NOTE_BATCHES = (*NOTE_ANSWERS, PLACED, MEMBERS)


def in_batch(expression: str, separator: str) -> str:
    return f"string_agg({expression}, {text(separator)} ORDER BY i)"


# --- prompts (fixed values: the wording that is sent) ---------------------------------------------------------------

CATEGORY_HEAD = (
    "List the 20 most relevant thematic categories for this sample of survey responses.\n"
    '    Return only a JSON list of category names, in the format: `["name1", "name2", ...]`\n'
    f"    \n    Question:\n    `{QUESTION}`\n    \n    Responses:\n    ```\n    "
)
SINGLE_HEAD = (
    "Categorize these responses to the following survey question using one of the provided categories.\n"
    "    Return only a JSON list where each element is a category name for each response, in the format: "
    '`["category for response 1", "category for response 2", ...]`.\n'
    f"    \n    Question:\n    `{QUESTION}`\n    \n    Responses:\n    `"
)
MULTI_HEAD = (
    "Categorize these responses to the following survey question using one or multiple of the provided "
    "categories.\n    Return only a JSON list where each element is a list of category names for each "
    'response, in the format: `[["category 1 for response 1", "category 2 for response 1", ...], '
    '["category 1 for response 2", "category 2 for response 2", ...], ...]`.\n'
    f"    \n    Question:\n    `{QUESTION}`\n    \n    Responses:\n    `"
)
CODING_TAIL = "`\n    \n    categories:\n    ```\n    " + "\n".join(NOTE_PROMPTABLE) + "\n    ```"


def coding_prompt(head: str) -> str:
    numbered = in_batch("concat(CAST(i + 1 AS VARCHAR), ': ', response)", "\n")
    return f"concat({text(head)}, {numbered}, {text(CODING_TAIL)})"


PROMPTS = (
    "prompts",
    f"SELECT batch_id, {coding_prompt(SINGLE_HEAD)} AS single, {coding_prompt(MULTI_HEAD)} AS multi "
    "FROM members GROUP BY batch_id",
)
COSTS = (
    "costs",
    "SELECT batch_id, (length(single) + 3) // 4 + 10 AS cost FROM prompts",
)


# --- the stand-in model ----------------------------------------------------


def hits(response: str, categories: list[str], separator: str) -> str:
    """All matching categories in list order, else Other."""
    cases = ", ".join(f"CASE WHEN contains({response}, {text(c.lower())}) THEN {text(c)} END" for c in categories)
    return f"coalesce(nullif(concat_ws({text(separator)}, {cases}), ''), 'Other')"


def first_hit(response: str, categories: list[str]) -> str:
    cases = " ".join(f"WHEN contains({response}, {text(c.lower())}) THEN {text(c)}" for c in categories)
    return f"CASE {cases} ELSE 'Other' END"


# --- codeframe application -------------------------------------------------

PART_CODE_ROWS = ("coded", PART_CODES.format(answers="answers"))


SINGLE_CODES = (
    "singles",
    "SELECT response, CASE WHEN NOT contains(response, 'rod') THEN nullif(split_part(codes, '|', 1), '') END "
    "AS category FROM coded",
)


def code_list(codes: str) -> str:
    """A bar-joined text as a list, empty for an empty text."""
    return f"list_filter(string_split({codes}, '|'), lambda c: c <> '')"


def known(codes: str, categories: list[str]) -> str:
    names = ", ".join(text(c) for c in categories)
    return f"list_filter(string_split({codes}, '|'), lambda c: c IN ({names}))"


def indicator(column: str, codes: str, category: str, missing: bool = True) -> str:
    """Rules for one indicator, from the list of known codes of the answer."""
    name = f'"{category}_{column}"'
    if category == "Uncategorized":
        rule = f"coalesce(len({codes}), 0) = 0 OR {codes}[-1] = 'Uncategorized'"
    else:
        rule = f"coalesce(list_contains({codes}, {text(category)}), false)"
    value = f"CAST(CASE WHEN {rule} THEN 1 ELSE 0 END AS BIGINT)"
    if missing:
        value = f"CASE WHEN {column} IS NULL THEN NULL ELSE {value} END"
    return f"{value} AS {name}"


def default(column: str, category: str) -> str:
    return f"CAST({int(category == 'Uncategorized')} AS BIGINT) AS \"{category}_{column}\""


def null_if_missing(column: str, category: str) -> str:
    value = f"CAST({int(category == 'Uncategorized')} AS BIGINT)"
    return f"CASE WHEN {column} IS NOT NULL THEN {value} END AS \"{category}_{column}\""


def applied(rows: tuple, codes: str, categories: list[str], keep: str = "id, r1, r2") -> str:
    """Both response columns looked up in ``coded(response, codes)``."""
    lists = ("lists", f"SELECT response, {known(codes, categories)} AS k FROM coded")
    found = (
        "found",
        "SELECT id, r1, r2, a.k AS k1, b.k AS k2 FROM cleaned "
        "LEFT JOIN lists AS a ON a.response = r1 LEFT JOIN lists AS b ON b.response = r2",
    )
    values = [indicator(r, k, c) for r, k in (("r1", "k1"), ("r2", "k2")) for c in categories]
    return with_tables(*rows, lists, found) + f"SELECT {keep}, {', '.join(values)} FROM found"


def applied_to_r1(codes: str) -> str:
    lists = ("lists", f"SELECT response, {known(codes, PART_CATEGORIES)} AS k FROM coded")
    found = ("found", "SELECT id, r1, r2, k FROM cleaned LEFT JOIN lists ON response = r1")
    values = [indicator("r1", "k", c) for c in PART_CATEGORIES] + [default("r2", c) for c in PART_CATEGORIES]
    steps = (*PART_ANSWERS, PART_CODE_ROWS, lists, found)
    return with_tables(*steps) + f"SELECT id, r1, r2, {', '.join(values)} FROM found"


KEYWORD_CODES = (
    "coded",
    f"SELECT response, {hits('response', NOTE_PROMPTABLE, '|')} AS codes FROM answers",
)
LINE_CODES = (
    "coded",
    "SELECT response, CASE WHEN response = 'n' THEN 'Red' ELSE 'Gear|Ring' END AS codes "
    "FROM answers WHERE response <> 'r'",
)
DEFAULTS = ", ".join(default(r, c) for r in ("r1", "r2") for c in PART_CATEGORIES)
NOTE_DEFAULTS = ", ".join(default(r, c) for r in ("r1", "r2") for c in NOTE_CATEGORIES)
MISSING = ", ".join(
    [null_if_missing("r1", c) for c in PART_CATEGORIES] + [default("r2", c) for c in PART_CATEGORIES]
)
PART_APPLIED = applied((*PART_ANSWERS, PART_CODE_ROWS), "codes", PART_CATEGORIES)

PART_APPLIED_SINGLE = applied((*PART_ANSWERS, PART_CODE_ROWS), "split_part(codes, '|', 1)", PART_CATEGORIES)


# --- replies ---------------------------------------------------------------

REPLY_ROWS = ("replies", REPLIES.format(part="part"))
IN_LIST = ", ".join(text(c) for c in PART_CATEGORIES)
VALIDATED = (
    with_tables(REPLY_ROWS)
    + f"""SELECT id,
  CASE kind WHEN 'STANDARD' THEN CASE WHEN w2 NOT IN ({IN_LIST}) OR w1 NOT IN ({IN_LIST}) THEN 'unknown_category' END
            WHEN 'ECONOMY' THEN 'not_a_string' WHEN 'PROMO' THEN 'not_a_list'
            WHEN 'SMALL' THEN 'not_json' ELSE 'not_a_string' END AS single_reason,
  CASE WHEN kind = 'STANDARD' AND w2 IN ({IN_LIST}) AND w1 IN ({IN_LIST}) THEN concat(w2, '|', w1) END
    AS single_codes,
  CASE kind WHEN 'PROMO' THEN 'not_a_list' WHEN 'SMALL' THEN 'not_json'
            WHEN 'LARGE' THEN CASE WHEN w2 NOT IN ({IN_LIST}) OR w1 NOT IN ({IN_LIST}) THEN 'unknown_category' END
            ELSE 'not_a_list_of_lists' END AS multi_reason,
  CASE WHEN kind = 'LARGE' AND w2 IN ({IN_LIST}) AND w1 IN ({IN_LIST}) THEN concat(w2, '+', w1, '|Red') END
    AS multi_codes
FROM replies"""
)
PARSED = (
    with_tables(REPLY_ROWS)
    + """SELECT id, kind NOT IN ('PROMO', 'SMALL') AS valid,
  CASE kind WHEN 'STANDARD' THEN concat(w2, '|', w1)
            WHEN 'ECONOMY' THEN concat(w2, '|', CAST(p.p_size AS VARCHAR))
            WHEN 'LARGE' THEN concat('["', w2, '","', w1, '"]|["Red"]')
            WHEN 'MEDIUM' THEN concat('["', w2, '"]|', w1) END AS categories
FROM replies JOIN part AS p ON p.p_partkey = id"""
)


# --- limits ----------------------------------------------------------------


def micros(amount: str, limit: int) -> str:
    return f"({amount} // {limit} * 60000000 + ({amount} % {limit} * 60000000 + {limit} - 1) // {limit})"


BUDGET = (
    with_tables(
        *NOTE_BATCHES,
        PROMPTS,
        COSTS,
        (
            "charged",
            "SELECT *, cost > 6000 AS oversize, CASE WHEN cost > 6000 THEN 0 ELSE cost END AS tokens, "
            "CASE WHEN cost > 6000 THEN 0 ELSE 1 END AS one FROM (SELECT batch_id, cost + 60 AS cost FROM costs) AS asked",
        ),
        (
            "summed",
            "SELECT batch_id, cost, oversize, tokens, row_number() OVER (PARTITION BY oversize ORDER BY batch_id) AS i, "
            + ", ".join(
                f"CAST(sum({c}) OVER (ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {name}"
                for c, name in (("tokens", "cum_tokens"), ("one", "cum_requests"))
            )
            + " FROM charged",
        ),
        # Request by request: the time, and when each allowance is full again. A token comes back
        # in 10 ms, a request in 15 s.
        (
            "replay(i, now, tokens_full, requests_full)",
            "SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL "
            "SELECT i, now, greatest(tokens_full, now) + weight, greatest(requests_full, now) + 15000000 FROM "
            "(SELECT s.i, tokens_full, requests_full, CAST(tokens * 10000 AS BIGINT) AS weight, "
            "greatest(now, tokens_full + CAST(tokens * 10000 AS BIGINT) - 60000000, requests_full - 45000000) AS now "
            "FROM replay JOIN summed AS s ON s.i = replay.i + 1 AND NOT s.oversize) AS step",
        ),
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""SELECT batch_id, cost, oversize, cum_tokens, cum_requests,
  CASE WHEN NOT oversize THEN greatest(0, greatest({micros('cum_tokens', 6000)}, {micros('cum_requests', 4)})
    - 60000000) END AS earliest_us,
  CASE WHEN NOT oversize THEN now END AS admit_us
FROM summed LEFT JOIN replay USING (i)"""
)


# --- jobs ------------------------------------------------------------------


def ordered(values: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS ord, {text(v)} AS category" for i, v in enumerate(values))


def proposed(count: int) -> str:
    """First words of the sample, then the defaults."""
    word = "split_part(response, ' ', 1)"
    words = ("words", f"SELECT {word} AS word, min(place) AS place FROM sample GROUP BY 1 ORDER BY 2 LIMIT {count}")
    named = (
        "named",
        "SELECT concat(upper(substr(word, 1, 1)), substr(word, 2)) AS category, place FROM words "
        + " ".join(f"UNION ALL SELECT {text(c)}, {10_000 + i}" for i, c in enumerate(DEFAULT_CATEGORIES)),
    )
    return with_tables(NOTE_ROWS, LONG, DISTINCT, SAMPLE, words, named)


TYPES_AND_ORDERS = """
WITH listed AS (
    SELECT DISTINCT concat('Order ', CAST(l_orderkey AS VARCHAR)) AS category, 0 AS later FROM lineitem
    UNION ALL
    SELECT DISTINCT concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))), 1 FROM part
    UNION ALL SELECT 'Other', 2 UNION ALL SELECT 'Bad response', 3 UNION ALL SELECT 'Uncategorized', 4)
SELECT CAST(row_number() OVER (ORDER BY later, category) - 1 AS INTEGER) AS ord, category FROM listed"""

PART_TYPES = "SELECT DISTINCT concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))) AS category FROM part"


def type_list(extra: list[str]) -> str:
    more = " ".join(f"UNION ALL SELECT {text(c)}, {i + 1}" for i, c in enumerate(extra))
    return (
        f"WITH kinds AS ({PART_TYPES}), listed AS (SELECT category, 0 AS later FROM kinds {more}) "
        "SELECT CAST(row_number() OVER (ORDER BY later, category) - 1 AS INTEGER) AS ord, category FROM listed"
    )


REDACTED = (
    r"regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+', "
    r"'<mail $1>', 'gs'), '[0-9]+', '#', 'gs'), 'the.{1,3}of', '<\\the>', 'gs')"
)

NOTE_CODEFRAME = (
    with_tables(*NOTE_ANSWERS) + f"SELECT response, {first_hit('response', NOTE_PROMPTABLE)} AS category FROM answers"
)
NOTE_CODEFRAME_MULTI = (
    with_tables(*NOTE_ANSWERS) + f"SELECT response, {hits('response', NOTE_PROMPTABLE, '|')} AS categories FROM answers"
)

ORACLE_SQL: dict[str, str] = {
    "S1_read_responses": f"SELECT id, r1, CASE WHEN r2 NOT IN ('N/A', 'null') THEN r2 END AS r2 "
    f"FROM ({CELLS.format(documents='documents')}) AS cells",
    "S2_decode_text": "SELECT CAST(doc_id AS VARCHAR) AS id, text AS r1 FROM documents",
    "S3_read_categories": TYPES_AND_ORDERS,
    "S4_read_codeframe_single": "SELECT p_name AS response, max_by(p_type, p_partkey) AS category FROM part GROUP BY 1",
    "S5_read_codeframe_multi": "SELECT p_name AS response, max_by(CASE WHEN p_size > 10 THEN "
    "concat(p_type, 'é\\|', p_brand, '''s|', substr(p_name, 1, 3), chr(160), 'A', chr(128512), chr(7), chr(11), '''\\q') "
    "ELSE '' END, p_partkey) AS categories FROM part GROUP BY 1",
    "S6_write_table": with_tables(NOTE_ROWS) + f"SELECT id, r1, nullif(r2, '') AS r2, {NOTE_DEFAULTS} FROM cleaned",
    "S7_write_codeframe": with_tables(*PART_ANSWERS, PART_CODE_ROWS)
    + "SELECT response AS key, CASE WHEN codes = '' THEN '[]' "
    "ELSE concat('[\"', replace(codes, '|', '\",\"'), '\"]') END AS value FROM coded",
    "P1_clean_text": f"SELECT 'documents' AS source, doc_id AS id, CAST(0 AS BIGINT) AS turn, {clean('text')} AS text "
    f"FROM documents UNION ALL SELECT 'conversations', conv_id, turn, {clean('text')} FROM conversations "
    f"UNION ALL SELECT 'pages', page_id, 0, {clean('html')} FROM pages",
    "P2_split_columns": f"SELECT id, CAST(2 AS BIGINT) AS columns, concat_ws('|', r1, r2) AS answers "
    f"FROM ({NOTES.format(documents='documents')}) AS raw",
    "P3_clean_all": with_tables(NOTE_ROWS) + "SELECT r1, r2 FROM cleaned",
    "P4_reassemble": with_tables(PART_ROWS) + "SELECT id, r1, r2 FROM cleaned",
    "P5_promptable_categories": type_list(["Other", "Bad response"]),
    "P6_redact_text": f"SELECT doc_id, {REDACTED} AS text FROM documents",
    "R1_unpivot": with_tables(NOTE_ROWS, LONG) + "SELECT id, response_column, response FROM long",
    "R2_distinct_keep_empty": with_tables(NOTE_ROWS, LONG, DISTINCT) + "SELECT response FROM answers_all",
    "R3_distinct_nonempty": with_tables(*NOTE_ANSWERS) + "SELECT response FROM answers",
    "R4_sample_n": with_tables(NOTE_ROWS, LONG, DISTINCT, SAMPLE) + "SELECT response FROM sample",
    "R5_batches": with_tables(*NOTE_BATCHES)
    + f"SELECT batch_id, count(*) AS n, {in_batch('response', '|')} AS responses FROM members GROUP BY batch_id",
    "M1_category_prompt": with_tables(NOTE_ROWS, LONG, DISTINCT, SAMPLE)
    + f"SELECT concat({text(CATEGORY_HEAD)}, '[''', string_agg(response, ''', ''' ORDER BY place), ''']', "
    f"{text(chr(10) + '    ```')}) AS prompt FROM sample",
    "M2_classify_prompt": with_tables(*NOTE_BATCHES, PROMPTS) + "SELECT batch_id, single, multi FROM prompts",
    "M3_estimate_tokens": with_tables(*NOTE_BATCHES, PROMPTS, COSTS) + "SELECT batch_id, cost FROM costs",
    "M4_request_budget": BUDGET,
    "M5_call_model": with_tables(*NOTE_BATCHES)
    + f"SELECT batch_id, concat({text('```json' + chr(10) + '[' + chr(34))}, "
    f"{in_batch(first_hit('response', NOTE_PROMPTABLE), chr(34) + ', ' + chr(34))}, "
    f"{text(chr(34) + ']' + chr(10) + '```')}) AS reply FROM members GROUP BY batch_id",
    "M6_strip_completion": "SELECT doc_id, replace(replace(replace(concat('```json', chr(10), text, 'json`', chr(10), "
    "'```'), 'json', ''), '`', ''), chr(10), '') AS reply FROM documents",
    "M7_parse_category_list": PARSED,
    "M8_validate_codes": VALIDATED,
    "M9_retry_then_error": with_tables(
        *NOTE_BATCHES,
        (
            "asked",
            f"SELECT batch_id, {in_batch(hits('response', NOTE_PROMPTABLE, '+'), '|')} AS codes, "
            f"{in_batch(text('Error'), '|')} AS errors, bool_or(contains(response, 'nicht')) AS refused, "
            "bool_or(contains(response, 'thing')) AS wrong FROM members GROUP BY batch_id",
        ),
    )
    + "SELECT batch_id, CASE WHEN refused THEN errors ELSE codes END AS codes, "
    "CAST(CASE WHEN refused THEN 6 WHEN wrong THEN 2 ELSE 1 END AS BIGINT) AS attempts, "
    "CASE WHEN refused THEN 'error' ELSE 'ok' END AS status, "
    "CASE WHEN refused THEN 'not_json' WHEN wrong THEN 'unknown_category' END AS last_error FROM asked",
    "M9_oversize_split": with_tables(
        *NOTE_BATCHES,
        PROMPTS,
        COSTS,
        (
            "parts",
            "SELECT m.batch_id, CASE WHEN split THEN i ELSE 0 END AS part, CASE WHEN split THEN 0 ELSE i END AS i, "
            "response FROM members AS m JOIN (SELECT batch_id, cost + 60 > 2000 AND n > 1 AS split FROM costs JOIN "
            "(SELECT batch_id, count(*) AS n FROM members GROUP BY batch_id) AS sizes USING (batch_id)) AS s "
            "USING (batch_id)",
        ),
        (
            "asked",
            f"SELECT batch_id, {in_batch('response', '|')} AS responses, "
            f"{in_batch(first_hit('response', NOTE_PROMPTABLE), '|')} AS codes, {in_batch(text('Error'), '|')} AS errors, "
            f"(length({coding_prompt(SINGLE_HEAD)}) + 3) // 4 + 70 > 2000 AS refused FROM parts GROUP BY batch_id, part",
        ),
    )
    + "SELECT batch_id, responses, CASE WHEN refused THEN errors ELSE codes END AS codes, "
    "CASE WHEN refused THEN 'error' ELSE 'ok' END AS status, "
    "CASE WHEN refused THEN 'over_token_limit' END AS last_error FROM asked",
    "M10_generate_categories": proposed(20)
    + "SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS ord, category FROM named",
    "M11_build_codeframe": with_tables(
        *NOTE_BATCHES,
        (
            "sized",
            "SELECT *, count(*) OVER (PARTITION BY batch_id) AS n, "
            "first_value(response) OVER (PARTITION BY batch_id ORDER BY i) AS leader FROM members",
        ),
    )
    + "SELECT response, concat('code ', CAST(i AS VARCHAR)) AS category FROM sized "
    "WHERE NOT (contains(leader, 'nicht') AND i = n - 1)",
    "C1_default_indicators": with_tables(PART_ROWS) + f"SELECT id, r1, r2, {DEFAULTS} FROM cleaned",
    "C2_missing_to_null": with_tables(PART_ROWS) + f"SELECT id, r1, r2, {MISSING} FROM cleaned",
    "C3_apply_single": applied_to_r1("split_part(codes, '|', 1)"),
    "C4_apply_multi": applied_to_r1("codes"),
    "C5_apply_all": PART_APPLIED,
    "C5_apply_all_shuffled": applied((*NOTE_ANSWERS, KEYWORD_CODES), "codes", NOTE_CATEGORIES),
    "C5_apply_all_shuffled_single": applied((*NOTE_ANSWERS, KEYWORD_CODES), "split_part(codes, '|', 1)", NOTE_CATEGORIES),
    "C5_apply_all_wide": "SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', "
    "CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, r1, CASE WHEN r1 IS NULL THEN NULL "
    "WHEN n % 10 = 9 THEN '2000' ELSE concat(CAST(least(n, 7 * n % 2000) AS STRING), CASE WHEN n = 7 * n % 2000 THEN '' "
    "ELSE concat(',', CAST(greatest(n, 7 * n % 2000) AS STRING)) END, CASE WHEN n % 5 = 0 THEN ',2000' ELSE '' END) END AS places "
    "FROM (SELECT *, l_partkey * 13 % 2000 AS n, CASE WHEN l_quantity > 2 THEN concat('slot ', CAST(l_partkey * 13 % 2000 AS "
    "STRING)) END AS r1 FROM lineitem) AS slots",
    "C5_apply_all_frequent": applied((LINE_ROWS, LONG, DISTINCT, ANSWERS, LINE_CODES), "codes", PART_CATEGORIES),
    "C5_apply_all_frequent_shuffled": applied(
        (LINE_ROWS, LONG, DISTINCT, ANSWERS, LINE_CODES), "codes", PART_CATEGORIES
    ),
    "C6_failed_audit_single": with_tables(*PART_ANSWERS, PART_CODE_ROWS, SINGLE_CODES)
    + "SELECT response, category FROM singles WHERE category = 'Error'",
    "C7_unknown_audit_single": with_tables(*PART_ANSWERS, PART_CODE_ROWS, SINGLE_CODES)
    + f"SELECT response, category AS code FROM singles WHERE category IS NULL OR category NOT IN ({IN_LIST})",
    "C6_failed_audit": with_tables(*PART_ANSWERS, PART_CODE_ROWS)
    + "SELECT response, codes AS categories FROM coded WHERE codes = 'Error'",
    "C7_unknown_audit": with_tables(
        *PART_ANSWERS, PART_CODE_ROWS, ("codes", f"SELECT response, unnest({code_list('codes')}) AS code FROM coded")
    )
    + f"SELECT response, code FROM codes WHERE code NOT IN ({IN_LIST})",
    "J1_generate_categories_job": proposed(25)
    + "SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS ord, category FROM named",
    "J2_build_codeframe_job": NOTE_CODEFRAME,
    "J2_build_codeframe_job_multi": NOTE_CODEFRAME_MULTI,
    # However a codeframe grows, it is the same in the end.
    "J2_extend_codeframe_job": NOTE_CODEFRAME,
    "J2_extend_codeframe_job_multi": NOTE_CODEFRAME_MULTI,
    # CSV holds no difference between an empty cell and a missing one.
    "J3_categorized_output_job_single": f"SELECT * REPLACE (nullif(r1, '') AS r1, nullif(r2, '') AS r2) "
    f"FROM ({PART_APPLIED_SINGLE}) AS applied",
    "J3_categorized_output_job": f"SELECT * REPLACE (nullif(r1, '') AS r1, nullif(r2, '') AS r2) "
    f"FROM ({PART_APPLIED}) AS applied",
}
