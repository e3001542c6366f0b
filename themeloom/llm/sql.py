"""The same results in DuckDB SQL, for the operators that SQL can express."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w
                        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
    FROM texts),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b
      ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (
    SELECT a, b FROM both_ways
    UNION
    SELECT reached.a, both_ways.b FROM reached JOIN both_ways ON reached.b = both_ways.a),
least_of AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(doc_id, b), doc_id) AS component_id,
       doc_id = coalesce(least(doc_id, b), doc_id) AS kept
FROM sets LEFT JOIN least_of ON doc_id = a"""

# Texts as hexadecimal, two letters a byte. Removed bytes are the union of 50-byte strings.
REMOVE_REPEATS = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- Short stretches first, as a place far into a long text is slow to reach.
stretches AS (
    SELECT doc_id, 500 * c AS base, substr(h, 1000 * c + 1, 1098) AS h
    FROM (SELECT doc_id, h, unnest(range(0, CAST(ceil(length(h) / 1000) AS BIGINT))) AS c FROM texts)),
places AS (
    SELECT doc_id, h, base,
           unnest(range(0, least(500, greatest(CAST(length(h) / 2 AS BIGINT) - 49, 0)))) AS i FROM stretches),
strings AS (SELECT doc_id, base + i AS i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS d FROM strings GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE doc_id > d),
marked AS (
    SELECT doc_id, i,
           CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS starts
    FROM hits),
numbered AS (SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span),
edges AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (
    SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
           string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
    FROM edges JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)"""

TOP_K = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5"""

URL_RULES = """
WITH rules(verdict, host, path) AS (VALUES
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
stems AS (
    SELECT row_number() OVER () AS n, page_id,
           regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END,
                          '^[^?#]*') AS stem
    FROM pages),
places AS (
    SELECT n, page_id, translate(regexp_extract(stem, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz') AS host,
           substr(stem, length(regexp_extract(stem, '^[^/]*')) + 1) AS path
    FROM stems),
fits AS (
    SELECT n, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
           arg_max(verdict, length(rules.host || rules.path)) AS verdict
    FROM places JOIN rules
      ON (places.host = rules.host OR ends_with(places.host, '.' || rules.host))
     AND starts_with(places.path, rules.path)
    GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM places LEFT JOIN fits USING (n)"""

# The table of CRC-32, and the sum over text ``f`` from its bytes ``h`` in hexadecimal.
CRC_TABLE = """
WITH RECURSIVE steps(k, b, v) AS (
    SELECT 0, b, b FROM range(256) t(b)
    UNION ALL
    SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),"""
CRC_SUM = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                  list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"""

# The sum is taken once for each distinct feature.
RESAMPLE = CRC_TABLE + r"""
texts AS (
    SELECT 'd' AS side, row_number() OVER () AS n, doc_id, text FROM documents
    UNION ALL SELECT 'b', -row_number() OVER (), NULL, text FROM benchmark),
words AS (
    SELECT side, n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
    SELECT side, n, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
hashed AS (
    SELECT f, """ + CRC_SUM + r""" % 10000 AS bucket
    FROM bytes, crc),
counts AS (
    SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
    FROM features JOIN hashed USING (f) GROUP BY bucket),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (S0 + 10000)) / ((s + 1)::DOUBLE * (T0 + 10000)))) AS BIGINT) AS g
    FROM counts, (SELECT sum(s) AS S0, sum(t) AS T0 FROM counts)),
weights AS (
    SELECT n, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight
    FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY n),
scored AS (
    SELECT n, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM words LEFT JOIN weights USING (n) WHERE side = 'd'),
totals AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (
    SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n) AS r FROM totals WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN r <= 25 * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank
FROM totals LEFT JOIN ranked USING (n)"""



def _further(way: str, cost: int | str, letters: str) -> str:
    """A cost of ten digits with its letters behind it, so that text order is cost, then letters; grown by an edit."""
    total = f"CAST(CAST(substr({way}, 1, 10) AS BIGINT) + {cost} AS VARCHAR)"
    return f"lpad({total}, 10, '0') || substr({way}, 11) || '{letters}'"


def _when(condition: str, way: str) -> str:
    return f"CASE WHEN {condition} THEN {way} ELSE '9' END"


# r0 to r3: the four states after insertions, before a row's own letter.
_REACHED = {
    "r0": "s0",
    "r1": "s1",
    "r2": f"least(s2, {', '.join(_further(s, 5, 'I') for s in ('s0', 's1', 's3'))})",
    "r3": f"least(s3, {_further('s2', 5, 'I')}, {_further('s0', 10, 'II')}, {_further('s1', 10, 'II')})",
}
_NOT_DELETED = "fault NOT IN ('blank', 'duplicate')"
_KEPT = {"s1": [("r0", "s")], "s2": [("r0", "u"), ("r1", "u"), ("r3", "u")], "s3": [("r2", "a")]}


def _next(state: str) -> str:
    ways = [_further(state.replace("s", "r"), 2, "D")]
    for before, letter in _KEPT.get(state, []):
        ways.append(_when(f"{_NOT_DELETED} AND letter = '{letter}'", _further(before, "extra", "K")))
        if letter != "s":
            ways.append(_when(_NOT_DELETED, _further(before, "extra + 1", "R")))
    return f"least({', '.join(ways)})"


# One row per conversation and step carries the best way to each of the four states.
REPAIR = CRC_TABLE + rf"""
rows AS (
    SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
bytes AS (SELECT key, hex(encode(key)) AS h FROM (SELECT DISTINCT key FROM rows)),
hits AS (SELECT key, {CRC_SUM} % 20 AS hit FROM bytes, crc),
damaged AS (
    SELECT conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
           CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
                    ELSE coalesce(text, ' ') END AS text,
           unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM rows JOIN hits USING (key) WHERE hit != 0),
ordered AS (
    SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
           row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
judged AS (
    SELECT *, substr(role, 1, 1) AS letter,
           CASE WHEN body = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS before
    FROM ordered),
walked(conv, i, s0, s1, s2, s3) AS (
    SELECT DISTINCT conv, CAST(0 AS BIGINT), '0000000000', '5000000000', '5000000000', '5000000000' FROM judged
    UNION ALL
    SELECT conv, i, {', '.join(_next(f's{k}') for k in range(4))}
    FROM (SELECT conv, judged.i, letter, fault, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra,
                 {', '.join(f'{way} AS {name}' for name, way in _REACHED.items())}
          FROM walked JOIN judged USING (conv) WHERE judged.i = walked.i + 1) AS reached),
ended AS (
    SELECT conv, least(s0, s3, {_further('s2', 5, 'I')}, {_further('s1', 10, 'II')}) AS way
    FROM walked QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1),
audits AS (SELECT conv, CAST(substr(way, 1, 10) AS BIGINT) AS cost, substr(way, 11) AS audit FROM ended),
edits AS (
    SELECT conv, p, substr(audit, p, 1) AS edit
    FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS p FROM audits)),
placed AS (
    SELECT *, count(*) FILTER (edit != 'I') OVER (PARTITION BY conv ORDER BY p) AS i,
           count(*) FILTER (edit != 'D') OVER (PARTITION BY conv ORDER BY p) AS n FROM edits),
lined AS (
    SELECT conv, p, n, edit, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, role,
           max(CASE WHEN n = 1 AND edit = 'K' AND letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS opened
    FROM placed LEFT JOIN judged USING (conv, i) WHERE edit != 'D'),
repaired AS (
    SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
                            || ':' || text, chr(10) ORDER BY p) AS lines
    FROM lined GROUP BY conv),
counted AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before || letter NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM rows) LEFT JOIN counted USING (conv) LEFT JOIN audits USING (conv)
     LEFT JOIN repaired USING (conv)"""

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": NEAR_DUPLICATES,
    "op4_remove_repeats": REMOVE_REPEATS,
    "op6_top_k": TOP_K,
    "op10_url_rules": URL_RULES,
    "op12_target_resampling": RESAMPLE,
    "op13_conversation_repair": REPAIR,
}
