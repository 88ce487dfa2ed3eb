"""URL filters against a plain loop over all rules, by both ways of fetching them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threadlens.llm.url_filter import filed_rules, filter_urls, parse_rules, url_host, url_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    "allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/",
    "block com/de/", "block net", "block /ads/", "allow a*.net/x*/y/", "block b.a+c.io/(1)/",
    "block dup.io/z", "allow dup.io/z", "block dup.io/z", "allow é.fr/ü/", "block */",
]
URLS = [
    None, "", "example.org/es/", "http://example.org", "http://example.org/", "HTTP://EXAMPLE.org/es/1",
    "https://www.example.org/es/a?b#c", "http://example.org/en/123", "http://example.org/en/1",
    "http://notexample.org/es/", "http://orgs/x", "x://a.com/fr/1://b.com/de/", "http://de.com/fr/de/",
    "http://com/de/", "http://xcom/de/", "http://a.com/DE/", "http://any.net", "http://abc.net/x/1/y/z",
    "http://abc.net/xx/y/", "http://q.de/ads/1", "http://b.a+c.io/(1)/", "http://b.aac.io/(1)/",
    "http://dup.io/z9", "http://é.fr/ü/1", "http://É.fr/ü/1", "http:///path", "://", "http://?q",
    "http://h#f/es/", "http://example.org:80/es/", "http://u@example.org/es/", "http://o.org/" + "s/" * 40_000,
    "http://a\nb.org/\nx", "http://.org/", "http://org./", "http://example.org/es",
]


def split(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (found[1].translate(str.maketrans(UPPER, LOWER)), found[2]) if found else ("", "")


def plain(url, rules, default="allow"):
    host, path = split(url)
    fit = []
    for line in rules:
        action, _, rule = line.partition(" ")
        rhost, slash, rest = rule.partition("/")
        rpath = slash + rest
        any_ = lambda s, star: star.join(re.escape(x) for x in s.split("*"))
        fits_host = not rhost or re.fullmatch(r"(?:[^/]*\.)?" + any_(rhost, "[^/]*"), host)
        fits_path = re.match("(?s)" + any_(rpath, ".*"), path) if rpath else path[:1] in ("", "/")
        if fits_host and fits_path:
            fit.append((len(rule), len(rhost), action == "block", rule, action))
    return (host, path, *(max(fit)[3:] if fit else (None, default)))


@pytest.mark.parametrize("lookup", [1000, 0])
def test_matches_a_loop_over_all_rules(spark, lookup):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    for rules in (RULES, RULES[:5], RULES[3:4], []):
        found = filter_urls(pages, parse_rules(spark, rules), lookup_rules=lookup).collect()
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
        assert got == {i: plain(u, rules) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("lookup", [1000, 0])
def test_hot_host_repeated_rows_null_ids_and_clashing_names(spark, lookup):
    pick = random.Random(5)
    hosts = ["hot.example.org"] * 6 + ["a.com", "b.net", "c.org"]
    urls = [f"http://{pick.choice(hosts)}/{pick.choice(['es', 'de', 'fr', 'en'])}/{i % 30}" for i in range(600)]
    rows = [(None if i % 3 else i, u, "x", "y", 1, "z", "t") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(
        rows, "page_id long, url string, rule string, token string, number int, best string, held string"
    )
    out = filter_urls(pages, parse_rules(spark, RULES[:5]), lookup_rules=lookup)
    assert out.columns == ["page_id", "url", "token", "number", "best", "held", "host", "path", "rule", "verdict"]
    got = sorted((r.page_id or -1, r.url, r.rule or "", r.verdict, r.token, r.best) for r in out.collect())
    want = sorted((r[0] or -1, r[1], plain(r[1], RULES[:5])[2] or "", plain(r[1], RULES[:5])[3], "y", "z") for r in rows)
    assert got == want
    assert filter_urls(pages.limit(0), parse_rules(spark, RULES[:5]), lookup_rules=lookup).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = ["http://example.org/es/1"] * 3 + ["http://x.example.org/en/2", "http://x.org/en/1"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    parts = pages.select(url_host("url").alias("host"), url_path("url").alias("path"))
    filed = {r.rule: r.token for r in filed_rules(parse_rules(spark, RULES), parts).collect()}
    assert filed["example.org/es/"] == "/es"
    assert filed["example.org/en/1"] == "/en"  # "1" may go on: it is no token
    assert filed["com/de/"] == ".com"  # no URL has either, the smaller one
    assert filed["*/"] == "" and filed["a*.net/x*/y/"] == ".net"


def test_only_fetched_rules_run_expressions(spark):
    """URLs without a rule's token never meet its pattern: a broken one does no harm there."""
    pages = spark.createDataFrame([("http://a.com/x/",)], "url string")
    rules = spark.createDataFrame([("block", "b.net", "/x/"), ("allow", "a.com", "/x/")], "action string, host string, path string")
    out = filter_urls(pages, rules).withColumn("n", F.lit(1)).first()
    assert (out.rule, out.verdict) == ("a.com/x/", "allow")


def test_rule_lines_are_checked(spark):
    with pytest.raises(ValueError):
        parse_rules(spark, ["drop example.org/"])
