"""URL rules against every rule for every url."""

import random
import re

import pytest
from pyspark.sql import functions as F

from themeloom.llm.url_rules import RULE_SCHEMA, RULES, _probes, judge_urls
from tests.llm import brute


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    return host.translate(brute.LOWER), slash + path


def judged(url, rules):
    host, path = parts(url)
    fits = [(h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    h, p, verdict = max(fits, key=lambda f: (len(f[0] + f[1]), len(f[0]), f[2]))
    return host, path, h + p, verdict


@pytest.mark.parametrize("ranges", [1, 7])
def test_random_rules_and_urls(spark, ranges):
    rng = random.Random(ranges)
    labels = ["a", "b", "ab", "org", "com", "é"]

    def host():
        return ".".join(rng.choices(labels, k=rng.randrange(1, 4)))

    def path(n):
        return "".join("/" + rng.choice(["x", "y", "xy", ""]) for _ in range(rng.randrange(n)))

    rules = [(rng.choice(["allow", "block"]), host(), "/" + path(3)[1:]) for _ in range(60)]
    urls = ["http://" + host() + path(5) + rng.choice(["", "?q=/", "#/x"]) for _ in range(500)]
    urls += ["https://hot.org/x/y"] * 300
    pages = spark.createDataFrame([(k, u, "r", "v") for k, u in enumerate(urls)],
                                  "page_id long, url string, rule string, verdict string")
    found = judge_urls(pages.repartition(4), spark.createDataFrame(rules, RULE_SCHEMA), ranges=ranges).collect()
    assert sorted(tuple(r) for r in found) == [(k, *judged(u, rules)) for k, u in enumerate(urls)]


def test_odd_urls(spark):
    urls = [None, "", "example.org/es/", "http://EXAMPLE.org/es/1", "http://ÉXAMPLE.org/es/", "http://xexample.org/es/",
            "http://example.org", "http://example.org?x=/es/", "ftp://a://example.org/es/", "http:///es/", "://",
            "http://a.example.org/en/12#", "http://example.org./es/", "http://example.org:80/es/", "HTTP://b.COM/de/",
            "http://b.com/fr/\nx", "http://..com/de/x", "http://" + "s." * 500 + "com/de/" + "p/" * 5000]
    rows = [(k if k != 5 else None, u) for k, u in enumerate(urls)] * 2
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = judge_urls(pages, rules).collect()
    want = [(k, *judged(u, RULES)) for k, u in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_probes_end_at_the_longest_rule(spark):
    host = ".".join(["a"] * 10_000) + ".example.org"
    places = spark.createDataFrame([(host, "/es/1"), ("", "/"), ("x.fr", "/")], "host string, path string")
    assert _probes(places, 2).groupBy("host").count().agg(F.max("count")).first()[0] == 2
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    (found,) = judge_urls(spark.createDataFrame([(1, f"https://{host}/es/1")], "page_id long, url string"), rules).collect()
    assert (found.rule, found.verdict) == ("example.org/es/", "block")
    none = judge_urls(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), rules.limit(0)).collect()
    assert [(r.host, r.rule, r.verdict) for r in none] == [("a.b", None, "allow")]
