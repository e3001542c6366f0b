"""Languages of texts, and of their spans, by Viterbi over per-word scores.

Words are runs of letters. The script of a word, by ranges of code points, leaves
the languages that use it in the training texts (all, if none does). Each of them
scores the word by the smoothed log-likelihood of its hashed letter pairs and
triples. A Viterbi pass over the words of a text, with a penalty for every change,
labels spans; the language that covers most letters is the text's, and its share
of the letters the score.

The counts come from a sample of about ``rows_per_language`` training rows of each
language, drawn by a hash of the id; the table of counts, languages times ``BUCKETS``,
goes to the driver and to the tasks. Texts are labelled whole.

Null texts and those without a letter are ``und`` with score 0 and no spans. With no
training rows every text is ``und``. Equal coverage goes to the language first in
order. Repeated rows and null ids are returned as they are, other columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.arrow import blobs, cut_by_bytes, map_texts

BUCKETS = 1 << 15
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01  # a language uses a script that this share of its words is written in
UNDETERMINED = "und"

# First code points of Unicode ranges and the script of each.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"), (0xD7FC, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_STARTS = np.array([start for start, _ in SCRIPT_RANGES], dtype=np.uint32)
_SCRIPT_OF_RANGE = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])


@functools.lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and each one's lower case where that is one code point."""
    letters = np.zeros(0x110000, dtype=bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            letters[code] = True
            small = char.lower()
            if len(small) == 1:
                lower[code] = ord(small)
    return letters, lower


class Words:
    """The words of some texts: where they lie and the buckets of their letter pairs and triples."""

    def __init__(self, texts: list[bytes | None]):
        letters, lower = _characters()
        codes = [np.frombuffer((t or b"").decode().encode("utf-32-le"), "<u4") for t in texts]
        sizes = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
        # A gap after each text ends its last word.
        ends = np.cumsum(sizes + 1)
        text = np.full(int(ends[-1]) + 2 if len(ends) else 2, 0x20, dtype=np.uint32)
        for code, end in zip(codes, ends.tolist()):
            text[end + 1 - len(code) : end + 1] = code
        text = lower[text]
        is_letter = letters[text]
        # Text k begins at starts[k], and position 0 and 1 are gaps.
        starts = ends + 1 - sizes
        before = np.concatenate([[False], is_letter[:-1]])
        after = np.concatenate([is_letter[1:], [False]])
        self.first = np.flatnonzero(is_letter & ~before)
        self.last = np.flatnonzero(is_letter & ~after)
        self.letters = self.last - self.first + 1
        self.doc = np.searchsorted(starts, self.first, side="right") - 1
        self.start = self.first - starts[self.doc] if len(self.first) else self.first
        self.script = _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, text[self.first], side="right") - 1]
        place = np.flatnonzero(is_letter)
        one = text[place]
        two = np.where(before[place], text[place - 1], 0)
        three = np.where(before[place] & before[place - 1], text[place - 2], 0)
        end_one = text[self.last]
        end_two = np.where(self.letters > 1, text[self.last - 1], 0)
        # Grams word by word: two per letter, then the one that ends the word.
        n = self.letters * 2 + 1
        self.grams_from = np.cumsum(n) - n
        word_of = np.repeat(np.arange(len(n)), self.letters)
        at = self.grams_from[word_of] + 2 * (place - self.first[word_of])
        self.buckets = np.empty(int(n.sum()), dtype=np.int64)
        self.buckets[at] = _bucket(np.uint64(1), two, one)
        self.buckets[at + 1] = _bucket(three.astype(np.uint64) + np.uint64(2), two, one)
        self.buckets[self.grams_from + n - 1] = _bucket(np.uint64(0x200000), end_two, end_one)


def _bucket(a, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = np.asarray(a, np.uint64).reshape(-1) * np.uint64(0x9E3779B97F4A7C15)
    x = x + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x + c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(49)).astype(np.int64)


class Model:
    """Log-likelihoods per bucket and language, and the languages of each script."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        totals = grams.sum(axis=0, keepdims=True) + SMOOTHING * BUCKETS
        self.logs = np.log((grams + SMOOTHING) / totals).astype(np.float32)
        uses = scripts >= SCRIPT_SHARE * scripts.sum(axis=0, keepdims=True)
        uses &= scripts > 0
        self.uses = np.where(uses.any(axis=1, keepdims=True), uses, True)

    def scores(self, words: Words) -> np.ndarray:
        """Per word and language, 0 for the best and below for others."""
        if not len(words.first):
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        sums = np.add.reduceat(self.logs[words.buckets], words.grams_from, axis=0)
        sums[~self.uses[words.script]] = -1e6
        return sums - sums.max(axis=1, keepdims=True)


def best_path(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word; all texts take a step at a time, longest first."""
    if not len(scores):
        return np.zeros(0, dtype=np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    lengths = np.diff(np.append(firsts, len(doc)))
    order = np.argsort(-lengths, kind="stable")
    firsts, lengths = firsts[order], lengths[order]
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than the step
    switched = np.zeros(scores.shape, dtype=bool)
    leader = np.zeros(len(scores), dtype=np.int16)
    now = scores[firsts]
    final = np.zeros(len(firsts), dtype=np.int64)
    for step in range(1, steps + 1):
        n = int(active[step]) if step < steps else 0
        final[n : len(now)] = now[n:].argmax(axis=1)
        if not n:
            break
        now = now[:n]
        lead = now.argmax(axis=1)
        jump = now[np.arange(n), lead][:, None] - penalty
        places = firsts[:n] + step
        leader[places] = lead
        switched[places] = jump > now
        now = np.maximum(now, jump) + scores[places]
    path = np.zeros(len(scores), dtype=np.int64)
    current = final
    for step in range(steps - 1, -1, -1):
        n = int(active[step])
        places = firsts[:n] + step
        path[places] = current[:n]
        jumped = switched[places, current[:n]]
        current[:n] = np.where(jumped, leader[places], current[:n])
    return path


COUNT_SCHEMA = "lang string, bucket int, n long"


def _count_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets, and of words per script behind them, for each language."""
    counts: dict[str, np.ndarray] = {}
    for batch in cut_by_bytes(batches, "text", 1 << 20):
        languages = np.array(batch.column("lang").to_pylist())
        texts = blobs(batch.column("text"))
        for language in set(languages.tolist()):
            words = Words([texts[k] for k in np.flatnonzero(languages == language)])
            total = counts.setdefault(language, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
            total[:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
            total[BUCKETS:] += np.bincount(words.script, minlength=len(SCRIPTS))
    for language, total in counts.items():
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([language] * len(bucket), pa.string()),
                pa.array(bucket.astype(np.int32)),
                pa.array(total[bucket]),
            ],
            ["lang", "bucket", "n"],
        )


def train(documents: DataFrame, rows_per_language: int = 1500, seed: int = 7) -> Model:
    """Counts over a sample of rows with ``doc_id``, ``text`` and ``lang``."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {row.lang: row.n for row in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    grams = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    if languages:
        shares = [x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, rows_per_language / sizes[lang])))]
        draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = rows.where(draw < F.create_map(*shares)[F.col("lang")]).select("lang", "text")
        counts = map_texts(sample, _count_task, COUNT_SCHEMA).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        found = counts.toArrow()
        column = np.searchsorted(languages, found.column("lang").to_pylist()) if len(found) else []
        table = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
        if len(found):
            table[found.column("bucket").to_numpy(), column] = found.column("n").to_numpy()
        grams, scripts = table[:BUCKETS], table[BUCKETS:]
    return Model(languages, grams, scripts)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
SCHEMA = (
    "doc_id long, lang_pred string, score double, n_letters long, "
    "spans array<struct<start:bigint,end:bigint,lang:string>>"
)


def _labelled(texts: list[bytes | None], model: Model, penalty: float) -> Iterator[tuple]:
    """Per text: language, score, letters, spans by code points."""
    words, scores, offset = [], [], 0
    size = first = 0
    for k, text in enumerate([*texts, None]):
        if k == len(texts) or size > 1 << 20:
            some = Words(texts[first:k])
            words.append((some.doc + first, some.start, some.letters))
            scores.append(model.scores(some))
            first, size = k, 0
        size += len(text or b"")
    doc, start, letters = (np.concatenate(column) for column in zip(*words))
    path = best_path(np.concatenate(scores), doc, penalty)
    n = len(model.languages)
    cover = np.bincount(doc * n + path, weights=letters, minlength=len(texts) * n).reshape(len(texts), n)
    total, best = cover.sum(axis=1), cover.argmax(axis=1)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])
    begins = np.flatnonzero(new)
    lasts = np.append(begins[1:], len(doc))[: len(begins)] - 1
    spans: list[list[dict]] = [[] for _ in texts]
    for d, a, b, lang in zip(
        doc[begins].tolist(), start[begins].tolist(), (start[lasts] + letters[lasts]).tolist(), path[begins].tolist()
    ):
        spans[d].append({"start": a, "end": b, "lang": model.languages[lang]})
    for k in range(len(texts)):
        if total[k]:
            yield model.languages[best[k]], float(cover[k, best[k]] / total[k]), int(total[k]), spans[k]
        else:
            yield UNDETERMINED, 0.0, 0, []


def identify_languages(
    documents: DataFrame,
    training: DataFrame,
    rows_per_language: int = 1500,
    penalty: float = SWITCH_PENALTY,
) -> DataFrame:
    """``doc_id, lang_pred, score, n_letters, spans`` of each document, learnt from the training rows."""
    model = train(training, rows_per_language)

    def run(batches):
        for batch in cut_by_bytes(batches, "text", 8 << 20):
            texts = blobs(batch.column("text"))
            if model.languages:
                columns = list(zip(*_labelled(texts, model, penalty)))
            else:
                columns = [[UNDETERMINED] * len(texts), [0.0] * len(texts), [0] * len(texts), [[]] * len(texts)]
            types = (pa.string(), pa.float64(), pa.int64(), SPANS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "lang_pred", "score", "n_letters", "spans"],
            )

    return map_texts(documents.select("doc_id", "text"), run, SCHEMA)
