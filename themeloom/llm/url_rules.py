"""URL rules by a sort-merge range join.

A rule ``host/path`` holds for its host and all subdomains where the url's path starts
with the rule's. With the host's labels reversed a key ``org.example/es/`` turns such
a rule into an interval of keys: all that start with it. A url has one probe key
per level of its host (``org/..``, ``org.example/..``) up to the most labels of any rule, so the rules that fit are those
whose interval holds one of its probes. Rules and probes are dealt out by ranges of
keys; in each range one sweep over the sorted keys keeps the nested rules that are
open on a stack, and the top of the stack is the longest rule for a probe. The
longest over a url's probes wins; of two equally long ones that with the longer host.

The bounds of the ranges come from a bounded sample of the probes and only balance the
work. A probe's key ends in a salt, so one key may be cut into several ranges. A
rule is sent to each range it reaches into: at a bound only the rules on one stack
do, which are at most as many as the key has characters. Equal hosts and paths are
judged once.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered. Path:
from there up to ``?``, ``#`` or the end. Null urls and those without ``://`` have both
empty and fit no rule. Rules given twice with the same verdict count once; with both
verdicts, ``block`` wins. Null ids and repeated rows are returned as they are, other
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # probes looked at to place the bounds of the ranges
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLASH = "\x01"  # between the host and the path of a key
END = "\x00"  # between a probe's key and its salt, below every character of a key
RULE_SCHEMA = "verdict string, host string, path string"

# (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    mark = F.instr(text, "://")
    rest = F.when(mark > 0, F.substring(text, mark + 3, F.length(text))).otherwise("")
    stem = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.regexp_extract(stem, r"^[^/]*", 0)
    return F.translate(host, UPPER, LOWER), F.substring(stem, F.length(host) + 1, F.length(stem))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _labels(host: str) -> Column:
    return F.split(host, r"\.", -1)


def _probes(places: DataFrame, most: int) -> DataFrame:
    """One row per place and level of its host, up to ``most``: ``host, path, key`` with a salt behind the key."""
    labels = F.slice(F.reverse(_labels("host")), 1, most)
    level = F.explode(F.sequence(F.lit(1), F.size(labels)))
    salt = F.lpad(F.hex(F.xxhash64("host", "path")), 16, "0")
    return (
        places.select("host", "path", labels.alias("labels"), level.alias("level"), salt.alias("salt"))
        .withColumn("stem", F.array_join(F.slice("labels", 1, F.col("level")), "."))
        .select("host", "path", F.concat("stem", F.lit(SLASH), "path", F.lit(END), "salt").alias("key"))
    )


def _ranges_of_rule(prefix: str, bounds: list[str]) -> range:
    """The ranges that may hold keys starting with ``prefix``."""
    last = bisect_right(bounds, prefix, key=lambda bound: bound[: len(prefix)])
    return range(bisect_right(bounds, prefix), last + 1)


def _sweep_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = None

    def events(batch: pa.RecordBatch) -> Iterator[tuple]:
        nonlocal part, stack
        names = ("part", "key", "is_rule", "host", "path", "rule", "verdict")
        for here, key, is_rule, host, path, rule, verdict in zip(*(batch.column(n).to_pylist() for n in names)):
            if here != part:
                part, stack = here, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if is_rule:
                stack.append((key, rule, verdict))
            elif stack:
                yield host, path, *stack[-1][1:]

    stack: list[tuple[str, str, str]] = []
    for batch in batches:
        found = list(events(batch))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.string()) for column in zip(*found)], ["host", "path", "rule", "verdict"]
            )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages`` with its ``url``.

    ``rules`` has ``verdict, host, path``; ``default`` is the verdict where no rule fits.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    places = pages.select("page_id", host.alias("host"), path.alias("path"))
    # No rule fits by more labels than the longest has.
    most = rules.agg(F.max(F.size(_labels("host")))).first()[0] or 1
    probes = _probes(places.where("host != ''").select("host", "path").distinct(), most)
    sample = probes.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS)
    keys = sorted(row.key for row in sample.collect())
    bounds = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []

    @F.udf("array<int>")
    def ranges_of_rule(prefix):
        return list(_ranges_of_rule(prefix, bounds))

    @F.pandas_udf("int")
    def range_of_probe(key):
        return key.map(lambda k: bisect_right(bounds, k))

    once = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    opened = (
        once.select("verdict", "host", "path", F.concat(_reversed(F.col("host")), F.lit(SLASH), "path").alias("key"))
        .withColumn("part", F.explode(ranges_of_rule("key")))
        .select(
            "part", "key", F.lit(True).alias("is_rule"), "host", "path",
            F.concat("host", "path").alias("rule"), "verdict",
        )
    )
    asked = probes.select(
        range_of_probe("key").alias("part"), "key", F.lit(False).alias("is_rule"), "host", "path",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    events = opened.unionByName(asked).repartition("part").sortWithinPartitions("part", "key", F.desc("is_rule"))
    fits = events.mapInArrow(_sweep_task, "host string, path string, rule string, verdict string")
    longest = fits.groupBy("host", "path").agg(
        F.max(
            F.struct(F.length("rule"), F.length(F.substring_index("rule", "/", 1)), F.col("rule"), F.col("verdict"))
        ).alias("best")
    )
    return places.join(longest, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
