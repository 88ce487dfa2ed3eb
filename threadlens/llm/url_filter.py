"""URL filters: pattern rules found through their rarest literal token.

A rule names a host and the beginning of a path. Its literal tokens are the labels of its
host and the path segments that it closes on both sides; every URL it fits holds all of
them. A rule is filed under the one of its tokens that fewest URLs hold. The tokens of a
URL fetch the rules filed under them, and only the regular expressions of those run. A
rule without a literal token is filed under the empty one, which every URL has.

A list of up to ``LOOKUP_RULES`` rules is a constant of the plan, an array of buckets by
token hash: URLs are then judged in one pass without a shuffle. A longer list is joined
by token, with the tokens that many URLs share salted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import LOWER, UPPER, packed_row, unpacked
from threadlens.operators.sizing import salted_join
from threadlens.session import cut_lineage

LOOKUP_RULES = 20_000
_FILED = "token string, pattern string, size int, host_size int, blocks boolean, rule string, action string"


def parse_rules(spark: SparkSession, lines: Sequence[str]) -> DataFrame:
    """(action, host, path) of lines such as ``block example.org/es/``. The path begins at
    the first slash; without one the rule fits every path of its host."""
    rows = []
    for line in lines:
        action, _, rule = line.strip().partition(" ")
        host, slash, rest = rule.strip().partition("/")
        if action not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {line!r}")
        rows.append((action, host.translate(str.maketrans(UPPER, LOWER)), slash + rest))
    return spark.createDataFrame(rows, "action string, host string, path string")


def url_host(url: Column | str) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z
    lower-cased; empty for a null URL or one without ``://``."""
    return F.translate(_part(url, 1), UPPER, LOWER)


def url_path(url: Column | str) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty where there is no host part."""
    return _part(url, 2)


def _part(url: Column | str, group: int) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def _url_tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: labels after a dot, segments after a slash."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("."), t))
    segments = F.transform(F.split(path, "/"), lambda t: F.concat(F.lit("/"), t))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(""))))


def _rule_tokens() -> Column:
    """The tokens that a URL fitting the rule is sure to hold. The last segment is open:
    a path may go on within it."""
    literal = lambda t: (t != "") & ~F.contains(t, F.lit("*"))
    labels = F.filter(F.split("host", r"\."), literal)
    parts = F.split("path", "/")
    closed = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.concat(
        F.transform(labels, lambda t: F.concat(F.lit("."), t)),
        F.transform(F.filter(closed, literal), lambda t: F.concat(F.lit("/"), t)),
    )


def _pattern() -> Column:
    """A rule's regular expression over host and path. ``*`` stands for any characters,
    in a host for any but a slash; an empty host is any host."""
    special = r"([\x21-\x29\x2B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])"
    plain = lambda c, any_: F.replace(
        F.regexp_replace(c, special, r"\\$1"), F.lit("*"), F.lit(any_)
    )
    host = F.concat(F.lit(r"(?:[^/]*\.)?"), plain(F.col("host"), "[^/]*"))
    host = F.when(F.col("host") == "", F.lit("[^/]*")).otherwise(host)
    path = F.when(F.col("path") == "", F.lit("(?:/|$)")).otherwise(plain(F.col("path"), ".*"))
    return F.concat(F.lit("(?s)^"), host, path)


def filed_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules (action, host, path) with their ``pattern`` and the ``token`` they are
    filed under: the one that fewest of ``urls`` (host, path) hold, the smaller one of
    equals. Equal rules are one."""
    rules = rules.select(
        "action", F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
    ).distinct()
    tokens = rules.select("host", "path", F.explode(_rule_tokens()).alias("token"))
    wanted = tokens.select(F.col("token").alias("wanted")).distinct()
    held = (
        urls.select(F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("found"))
        .groupBy("found").agg(F.count("*").alias("n"))
    )
    counts = wanted.join(held, F.col("wanted") == F.col("found"), "left").select(
        "wanted", F.coalesce("n", F.lit(0)).alias("n")
    )
    rarest = (
        tokens.join(counts, F.col("token") == F.col("wanted"))
        .groupBy(F.col("host").alias("h"), F.col("path").alias("p"))
        .agg(F.min(F.struct("n", "token")).alias("least"))
    )
    same = (F.col("host") == F.col("h")) & (F.col("path") == F.col("p"))
    return rules.join(rarest, same, "left").select(
        F.coalesce("least.token", F.lit("")).alias("token"), _pattern().alias("pattern"),
        (F.char_length("host") + F.char_length("path")).alias("size"),
        F.char_length("host").alias("host_size"), (F.col("action") == "block").alias("blocks"),
        F.concat("host", "path").alias("rule"), "action",
    )


def _rank(rule: Column) -> Column:
    """The order of rules that fit one URL, the last one wins."""
    names = ("size", "host_size", "blocks", "rule", "action")
    return F.struct(*(rule[n].alias(n) for n in names))


def _looked_up(urls: DataFrame, filed: DataFrame, count: int) -> DataFrame:
    """Add ``best``, with the rules as a constant array of buckets."""
    buckets = 1
    while buckets < 2 * count:
        buckets *= 2
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")
    rules = filed.select(place(F.col("token")).alias("bucket"), F.struct("*").alias("rule"))
    table: list[list[str]] = [[] for _ in range(buckets)]
    for row in rules.select("bucket", F.to_json("rule").alias("rule")).collect():
        table[row["bucket"]].append(row["rule"])  # LOOKUP_RULES rows at most
    text = "[" + ",".join(f"[{','.join(sorted(rows))}]" for rows in table) + "]"
    index = F.from_json(F.lit(text), f"array<array<struct<{_FILED.replace(' ', ':').replace(',:', ',')}>>>")
    tokens = _url_tokens(F.col("host"), F.col("path"))
    fetched = F.flatten(
        F.transform(tokens, lambda t: F.filter(F.get(index, place(t)), lambda r: r["token"] == t))
    )
    subject = F.concat("host", "path")
    fit = F.filter(fetched, lambda r: F.regexp_like(subject, r["pattern"]))
    return urls.withColumn("best", F.array_max(F.transform(fit, _rank)))


def _joined(urls: DataFrame, filed: DataFrame) -> DataFrame:
    """Add ``best`` for a rule list of any length."""
    urls = cut_lineage(urls.withColumn("number", F.monotonically_increasing_id()))
    tokens = urls.select(
        "number", F.concat("host", "path").alias("subject"),
        F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("held"),
    )
    filed = cut_lineage(filed)
    fetched = salted_join(tokens, filed, "held", "token", ["number", "held"])
    best = (
        fetched.where(F.regexp_like("subject", F.col("pattern")))
        .groupBy(F.col("number").alias("found"))
        .agg(F.max(F.struct("size", "host_size", "blocks", "rule", "action")).alias("best"))
    )
    return urls.join(best, F.col("number") == F.col("found"), "left")


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
    lookup_rules: int = LOOKUP_RULES,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has action (allow or block), host and path. A rule fits its host and all
    subdomains where the URL's path begins with the rule's. Of several the longest wins
    (host and path together), then the one with the longer host, then a block.
    ``rule`` is that rule's host and path, null without one; the verdict is then ``default``.

    A null URL or one without ``://`` has an empty host and path. Rows are judged one by
    one: repeated rows and null ids stay as they are. Columns of ``pages`` named like an
    added one are replaced. No rules or no rows are fine."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    row = packed_row(names) if names else F.struct(F.lit(None).alias("none")).alias("row")
    urls = pages.select(row, url_host(url).alias("host"), url_path(url).alias("path"))
    filed = cut_lineage(filed_rules(rules, urls.select("host", "path")))
    count = filed.count()
    judged = _looked_up(urls, filed, count) if count <= lookup_rules else _joined(urls, filed)
    return judged.select(
        *unpacked(names), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
