"""Main text of web pages by line-block distribution.

The markup of a page is cut into lines, one per block element, in page order. A
line weighs as many characters as its text has outside of links. Lines of parts that
never belong to an article (navigation, headers, footers, sidebars, forms, adverts,
notices, comments and the like, known by element, role or class) are taken out
before. A block that only shares a word with them in a longer class ("has-sidebar")
goes where it weighs less than half of the page. The weights are summed over a sliding window of lines. The text begins
where the sum surges past a threshold, and before that with the short lines next to it
(title, author, date), and ends where it dives to nothing. Stretches that only a few
lines of links part, or a part lighter than either, are one. The heaviest is the
main text, with every line from its first to its last. Lines in a marked article (an
``<article>`` or ``<main>``) are a stretch from the first to the last, and each weighs
``SURGE`` more. The mark is a bonus and no more: text outside wins where it is heavier.

Scripts, styles, comments and other elements without running text are dropped.
Character references are decoded by the rules of HTML, white space within a line
becomes one space, lines are trimmed, empty ones dropped, the rest joined by a line
feed. Nothing else is dropped or cut.

Null or empty pages give an empty text, unclosed or misnested markup is read as far as
it goes, repeated rows and null ids are returned as they are, an empty table gives no
rows; other columns are carried along unless they are named like the result.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3  # lines in the sliding window
SURGE = 80  # characters in the window where the text begins
PARTING = 2 * WINDOW  # lines of links that never part a text
MOST_DOUBTS = 32  # elements in doubt around a line; one within more of them is in no more doubt than these

# Elements of HTML.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = "script style template noscript iframe object svg math canvas audio video select textarea button head".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
ARTICLE = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
CLASS_WORDS = set(
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "popup promo promotion related share sharing sidebar skip social sponsor sponsored subscribe subscription "
    "toolbar widget".split()
)
COMMENT = {"comment", "comments"}
# An element opened next to an open one of the same kind closes that one first.
CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
# A tag with a stray quote.
_LOOSE = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>[^<>]*)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
_SPACE = re.compile(r"\s+")


NO, MAYBE, YES = range(3)


def never_article(name: str, rest: str, inside_article: bool) -> int:
    """Whether an element is of a kind that holds no main text; an article may have a header of its own.

    A class that is one of the words, or begins with ``comment``, says so. A block with the word
    beside others ("has-sidebar", "social-science") may hold it: what it weighs decides.
    """
    if name in NEVER and not (name == "header" and inside_article):
        return YES
    if not rest:
        return NO
    found = NO
    for key, *values in _ATTRIBUTE.findall(rest):
        value = "".join(values).lower()
        if name in ("body", "html"):
            continue
        if key.lower() == "role":
            if ROLES & set(re.split(r"[^a-z0-9]+", value)):
                return YES
            continue
        whole = set(value.split())
        parts = {w: re.split(r"[^a-z0-9]+", w) for w in whole}
        if name in ARTICLE:
            # What it is comes first ("comment-body"); "has-sidebar" or the "sidebar-left" of a main are about its place.
            if CLASS_WORDS & (whole if name == "main" else {words[0] for words in parts.values()}):
                return YES
        elif CLASS_WORDS & (whole | {words[0] for words in parts.values() if words[0] in COMMENT}):
            return YES
        elif any(CLASS_WORDS.intersection(words) for words in parts.values()):
            if name not in BLOCKS:
                return YES
            found = MAYBE
    return found


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Lines as (text, characters outside of links, whether in a marked article), without the never-article parts."""
    lines: list[tuple[str, int, bool]] = []
    doubts: list[tuple[int, ...]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    words: list[str] = []
    in_doubt: tuple[int, ...] = ()
    dropped = articles = links = linked = n_doubts = 0
    at = 0

    def end_line() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
        if text:
            # A line that is mostly links is a menu.
            lines.append((text, len(text) - linked if 2 * linked < len(text) else 0, articles > 0))
            doubts.append(in_doubt)
        words.clear()
        linked = 0

    def pop() -> str:
        nonlocal dropped, articles, links, in_doubt
        name, never = stack.pop()
        opened[name] -= 1
        dropped -= never == YES
        if never == MAYBE:
            in_doubt = in_doubt[:-1]
        articles -= name in ARTICLE
        links -= name == "a"
        return name

    while match := _TOKEN.match(page, at):
        text = match["text"]
        if text == "<" and (loose := _LOOSE.match(page, at)):
            match, text = loose, None
        elif text is None:
            text = match["cdata"]
        at = match.end()
        if text:
            if not dropped:
                words.append(text)
                linked += len(text) if links else 0
            continue
        if not match["name"]:
            continue
        name = match["name"].lower()
        if name in _RAW_END:
            if not match["close"] and not match["rest"].endswith("/"):
                end = _RAW_END[name].search(page, at)
                # An unclosed head ends where the body begins; anything else runs to the end.
                stop = re.compile(r"<body\b", re.IGNORECASE).search(page, at) if name == "head" else None
                at = end.end() if end else stop.start() if stop else len(page)
            continue
        if name == "br":
            if not dropped:
                words.append(" ")
            continue
        if name in BLOCKS and not dropped:
            end_line()
        if match["close"]:
            if opened[name]:
                while pop() != name:
                    pass
        elif name not in VOID and not match["rest"].endswith("/"):
            if name in CLOSES_ITSELF and stack and stack[-1][0] == name:
                pop()
            never = never_article(name, match["rest"], articles > 0)
            if never == MAYBE and len(in_doubt) == MOST_DOUBTS:
                never = NO
            stack.append((name, never))
            opened[name] += 1
            dropped += never == YES
            if never == MAYBE:
                in_doubt, n_doubts = (*in_doubt, n_doubts), n_doubts + 1
            articles += name in ARTICLE
            links += name == "a"
    if not dropped:
        end_line()
    return settled(lines, doubts)


def settled(lines: list[tuple[str, int, bool]], doubts: list[tuple[int, ...]]) -> list[tuple[str, int, bool]]:
    """The lines without those of elements in doubt that hold less than half of what the page's lines weigh."""
    weights: Counter[int] = Counter()
    for (_, n, _), within in zip(lines, doubts):
        for doubt in within:
            weights[doubt] += n
    total = sum(n for _, n, _ in lines)
    light = {doubt for doubt, n in weights.items() if 2 * n < total or not n}
    return [line for line, within in zip(lines, doubts) if light.isdisjoint(within)]


def stretches_of(lines: list[tuple[str, int, bool]]) -> list[tuple[int, int, int]]:
    """Stretches of text as (weight, first line, line after the last); none is both inside and outside of a mark."""
    found: list[tuple[int, int, int]] = []
    low = 0
    for marked, run in itertools.groupby(lines, key=lambda line: line[2]):
        weights = [n for _, n, _ in run]
        if marked:
            found.append((sum(weights) + SURGE * len(weights), low, low + len(weights)))
        start = None
        for k in range(0 if marked else len(weights) + 1):
            block = sum(weights[k : k + WINDOW])
            if start is None and k < len(weights) and block >= SURGE and weights[k]:
                start = k
                while start and weights[start - 1]:
                    start -= 1
            elif start is not None and not block:
                found.append((sum(weights[start:k]), low + start, low + k))
                start = None
        low += len(weights)
    return found


def joined(lines: list[tuple[str, int, bool]], stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The stretches of one kind, those put together that little parts."""
    found: list[tuple[int, int, int]] = []
    before = 0
    for weight, first, last in stretches:
        if found:
            whole, begin, end = found[-1]
            between = lines[end:first]
            few = len(between) <= PARTING and not any(n or marked for _, n, marked in between)
            if few or sum(len(text) for text, _, _ in between) <= min(before, weight):
                weight, first, before = whole + weight, begin, weight
                found[-1] = (weight, first, last)
                continue
        found.append((weight, first, last))
        before = weight
    return found


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    stretches = stretches_of(lines)
    if not stretches:
        # A page with too little text for any surge: all lines that are not mere links.
        return "\n".join(text for text, n, _ in lines if n)
    kinds = ([s for s in stretches if lines[s[1]][2] == marked] for marked in (True, False))
    _, first, last = max((s for kind in kinds for s in joined(lines, kind)), key=lambda stretch: stretch[0])
    return "\n".join(text for text, _, _ in lines[first:last])


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``text`` and ``n_chars`` (its code points) next to the other columns of the pages."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    others = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    found = pages.select(*others, extracted(F.col(column)).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
