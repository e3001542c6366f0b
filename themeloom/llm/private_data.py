"""Personal data in texts: exact patterns, and identifiers that stand where those stand.

The base kinds are fixed patterns with checks, found from the left without overlap, each kind
apart. They are the seeds of a bootstrapped search for what the patterns cannot see. A
lexical pattern is a pair of words beside an identifier: the two before it, the two after it, or
one on each side. Candidates are words with a digit or an at sign that no base span touches. In
rounds, Spark scores the graph of patterns and distinct identifiers: a pattern is trusted
with the share of known identifiers of one kind among all it is met with, and needs
several of them; an unknown identifier is found with the chance that not all of its
trusted patterns are wrong, and is known in the next round. So a version number
behind the words of a licence stays alone, however often it is copied.

Everything is DataFrame expressions. The patterns are written so that Java's matcher neither
recurses nor looks at a run of letters twice: texts of any length are read whole. Texts are
scanned once; what goes on are spans and a few words beside them.

Nulls: a null text is empty and has no spans; null ids are kept. Repeated rows get equal
results, and repeated texts add nothing to a pattern, as identifiers are counted once. Empty tables
give no rows. Only the id and the text of a document are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.tables import materialize

# Kinds in the order of the results, and their patterns. A repetition that never
# has to give anything back is possessive; runs are only entered at their start.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for its kind to be looked for at all.
HINTS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
# Parts of an address up to 255, whatever zeros stand before.
ADDRESS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}"

# Code points beside a span in which its words are looked for.
BESIDE = 80


def _luhn(digits: Column) -> Column:
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda value: F.lit(True),
    "ip": lambda value: F.rlike(value, F.lit(ADDRESS)),
    "card": _card,
    "phone": lambda value: F.length(_digits(value)).between(9, 15),
}


def _scan(sizes: Column) -> Column:
    """Running sums of a short array."""
    start = F.struct(F.array().cast("array<long>").alias("sums"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        sizes, start,
        lambda done, size: F.struct(
            F.concat(done["sums"], F.array(done["sum"] + size)).alias("sums"), (done["sum"] + size).alias("sum")
        ),
        lambda done: done["sums"],
    )


def running_sums(df: DataFrame, name: str, run: int = 256) -> DataFrame:
    """The array column ``name`` of longs replaced by its running sums, in runs, so that long arrays are not copied often."""
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(name) / run).cast("int") - 1, F.lit(0))),
        lambda k: _scan(F.slice(name, k * run + 1, run)),
    )
    df = df.withColumn("runs", runs)
    df = df.withColumn("totals", F.transform("runs", lambda sums: F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0))))
    df = df.withColumn("bases", _scan(F.col("totals")))
    moved = F.transform(
        F.arrays_zip("runs", "bases", "totals"),
        lambda z: F.transform(z["runs"], lambda x: x + z["bases"] - z["totals"]),
    )
    return df.withColumn(name, F.flatten(moved)).drop("runs", "totals", "bases")


def _last_words(text: Column) -> Column:
    return F.slice(F.reverse(F.regexp_extract_all(F.substring(text, -BESIDE, BESIDE), F.lit(r"\p{L}+"), F.lit(0))), 1, 2)


def _first_words(text: Column) -> Column:
    return F.slice(F.regexp_extract_all(F.substring(text, 1, BESIDE), F.lit(r"\p{L}+"), F.lit(0)), 1, 2)


def spans(df: DataFrame, name: str, pattern: str, hint: str, check: Callable[[Column], Column]) -> DataFrame:
    """Column ``name``: start, end, value and the two nearest words on either side of each match in ``text``.

    Matches, and the pieces between them, come from two scans by one pattern; places follow by
    adding up their lengths.
    """
    hit = F.rlike("text", F.lit(hint))
    hits = F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("hits", hits)
    # Without a match the text is one piece that nobody asks for.
    pieces = F.when(F.size("hits") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("pieces", pieces)
    ends = F.transform("hits", lambda value, i: (F.length(F.get("pieces", i)) + F.length(value)).cast("long"))
    df = running_sums(df.withColumn("ends", ends), "ends")
    found = F.transform(
        "hits",
        lambda value, i: F.struct(
            (F.get("ends", i) - F.length(value)).alias("start"), F.get("ends", i).alias("end"), value.alias("value"),
            _last_words(F.get("pieces", i)).alias("left"), _first_words(F.get("pieces", i + 1)).alias("right"),
        ),
    )
    return df.withColumn(name, F.filter(found, lambda x: check(x["value"]))).drop("hits", "pieces", "ends")


def base_spans(documents: DataFrame) -> DataFrame:
    """``(row, doc_id, email, ip, card, phone, token)``, an array of spans for each kind and for words with digits."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    df = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text)
    for kind in KINDS:
        df = spans(df, kind, PATTERNS[kind], HINTS[kind], CHECKS[kind])
    return spans(df, "token", TOKEN, "[0-9@]", lambda value: F.lit(True)).drop("text")


def _of_kind(kind: str) -> Column:
    return F.transform(kind, lambda x: x.withField("kind", F.lit(kind)))


def mentions(found: DataFrame, longest: int) -> DataFrame:
    """One row for each base span and each candidate that touches none: ``(row, start, end, value, kind, patterns)``."""
    rows = found.select("row", F.inline(F.concat(*[_of_kind(kind) for kind in (*KINDS, "token")])))
    # A candidate is a word without the signs around it.
    is_token = F.col("kind") == "token"
    before = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}]*", 0))
    after = F.length(F.regexp_extract(F.reverse("value"), r"^[^\p{L}\p{N}]*", 0))
    rows = rows.withColumns({"skip": F.when(is_token, before).otherwise(0), "cut": F.when(is_token, after).otherwise(0)})
    rows = rows.withColumns({
        "start": F.col("start") + F.col("skip"), "end": F.col("end") - F.col("cut"),
        "value": F.substr("value", F.col("skip") + 1, F.greatest(F.length("value") - F.col("skip") - F.col("cut"), F.lit(0))),
    })
    in_row = Window.partitionBy("row")
    earlier = F.max(F.when(~is_token, F.col("end"))).over(in_row.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(~is_token, F.col("start"))).over(
        in_row.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    )
    touched = F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False))
    rows = rows.withColumn("touched", touched).where(~is_token | (~F.col("touched") & F.length("value").between(1, longest)))
    near = lambda words: F.when(F.size(words) == 2, F.array_join(words, " "))
    across = F.when((F.size("left") > 0) & (F.size("right") > 0), F.concat(F.get("left", F.lit(0)), F.lit(" "), F.get("right", F.lit(0))))
    patterns = F.array(F.concat(F.lit("before "), near(F.col("left"))), F.concat(F.lit("after "), near(F.col("right"))), F.concat(F.lit("across "), across))
    return rows.select(
        "row", "start", "end",
        F.when(F.length("value") <= longest, F.col("value")).otherwise(F.sha2("value", 256)).alias("value"),
        F.when(~is_token, F.col("kind")).alias("kind"), F.array_compact(patterns).alias("patterns"),
    )


def _spread_join(large: DataFrame, small: DataFrame, key: str, by: str, copies: int = 16) -> DataFrame:
    """An inner join in which one ``key`` of ``large`` is dealt to ``copies`` tasks by its ``by``."""
    dealt = large.withColumn("deal", F.pmod(F.xxhash64(by), F.lit(copies)))
    copied = small.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)).cast("array<long>")))
    return dealt.join(copied, [key, "deal"]).drop("deal")


def discovered(rows: DataFrame, rounds: int, trust: float, support: float, certain: float) -> DataFrame | None:
    """``(value, kind)`` of the unknown identifiers that the graph of patterns and identifiers yields, if any."""
    edges = rows.select("value", "kind", F.explode("patterns").alias("pattern"))
    # A value that is a base span somewhere is known wherever it stands.
    edges = materialize(edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "edges")
    unknown = edges.where(F.col("kind").isNull()).drop("kind")
    found = None
    for _ in range(rounds):
        learnt = edges.limit(0) if found is None else _spread_join(unknown, found, "value", "pattern")
        # An edge learnt is there twice, once without its kind, and counts once.
        known = edges.withColumn("met", F.lit(1)).unionByName(learnt.withColumn("met", F.lit(0)))
        shares = [F.count_if(F.col("kind") == kind) for kind in KINDS]
        most = F.greatest(*shares)
        best = F.coalesce(*[F.when(share == most, F.lit(kind)) for kind, share in zip(KINDS, shares)])
        scored = known.groupBy("pattern").agg(F.sum("met").alias("met"), most.alias("known"), best.alias("kind"))
        scored = scored.withColumn("trust", F.col("known") / (F.col("met") + 1))
        trusted = scored.where((F.col("trust") >= trust) & (F.col("known") >= support)).select("pattern", "kind", "trust")
        votes = _spread_join(unknown, trusted, "pattern", "value").groupBy("value", "kind")
        # The log of the chance that all are wrong; sums may differ in their last digits.
        doubts = votes.agg(F.sum(F.log(1 - F.col("trust"))).alias("doubt"))
        doubts = doubts.where(F.col("doubt") <= math.log(1 - certain) + 1e-9)
        now = materialize(doubts.groupBy("value").agg(F.min_by("kind", F.struct("doubt", "kind")).alias("kind")), "identifiers")
        more = now.count() - (found.count() if found is not None else 0)
        found = now
        if more <= 0:
            break
    return None if found.isEmpty() else found


def _places(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _sorted_kind(places: Column, kind: str) -> Column:
    return F.array_sort(F.filter(places, lambda x: x["kind"] == kind))


def _digest(kind_spans: Column) -> Column:
    texts = F.transform(kind_spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"], F.lit(":"), x["end"]))
    return F.array_join(texts, ",")


def find_private_data(
    documents: DataFrame,
    rounds: int = 3,
    trust: float = 0.8,
    support: int = 4,
    certain: float = 0.95,
    longest: int = 64,
) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added)``; counts are of base spans.

    ``base`` and ``spans`` list ``kind:start:end`` in code points, the end exclusive, by kind and
    start; ``spans`` holds the base ones and those found beside trusted patterns. An identifier of
    more than ``longest`` code points is no candidate.
    """
    # Written, so a row keeps its number when tasks run again.
    found = materialize(base_spans(documents), "spans")
    rows = materialize(mentions(found, longest), "mentions")
    values = discovered(rows, rounds, trust, support, certain)
    base = F.concat(*[_places(kind) for kind in KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    result = found.select("row", "doc_id", *counts, base.alias("base"))
    if values is None:
        none = F.lit(0).cast("long").alias("n_added")
        text = _digest(F.col("base"))
        return result.select("doc_id", *[f"n_{k}" for k in KINDS], text.alias("base"), text.alias("spans"), none)
    unknown = rows.where(F.col("kind").isNull()).drop("kind", "patterns")
    added = _spread_join(unknown, values, "value", "row").groupBy("row")
    added = added.agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    result = result.join(added, "row", "left")
    nothing = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    more = F.coalesce("added", nothing)
    every = F.concat(*[_sorted_kind(F.concat("base", more), kind) for kind in KINDS])
    return result.select(
        "doc_id", *[f"n_{k}" for k in KINDS], _digest(F.col("base")).alias("base"), _digest(every).alias("spans"),
        F.size(more).cast("long").alias("n_added"),
    )
