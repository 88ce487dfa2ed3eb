"""Column functions for ids, flags, timestamps and message text.

Java's ``\\w`` and ``\\s`` are ASCII only, so the patterns spell out the Unicode
classes. Most read the same in Java regex and RE2, which lets the SQL checks
share them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.spaces import plain, squashed

WS = r"\s\p{Z}\x0B\x1C-\x1F\x{85}"
WORD = r"\p{L}\p{N}_"
SPACES = f"[{WS}]+"
# The same but for single plain spaces, which are most: replacing these by themselves costs
# more than all else. Visible ASCII is passed over by one test.
UNEVEN_SPACES = f"(?![!-~])(?: [{WS}]|[{WS}&&[^ ]])[{WS}]*"
EDGE_SPACES = f"^[{WS}]+|[{WS}]+$"
NON_SPACES = f"[^{WS}]+"
URL = f"https?://[^{WS}]+"
URL_WWW = f"https?://[^{WS}]+|www\\.[^{WS}]+"
# The same for Java, which passes over all but two letters by one test.
URL_WWW_QUICK = f"[hw](?:(?<=h)ttps?://[^{WS}]+|(?<=w)ww\\.[^{WS}]+)"
_URL_MARKS = ("://", "www.")
MENTION = f"@[{WORD}]+"
HASHTAG = f"#[{WORD}]+"
ENTITY = f"&[{WORD}]+;"
RETWEET = f"rt(?<![{WORD}]rt)(?![{WORD}])"  # looks back only where "rt" stands
# On lowered text: everything but a-z, 0-9 and the apostrophe. Java runs the named
# ASCII class several times faster than the spelled-out ranges.
NOT_PLAIN = r"[^\p{Alnum}']+"
# The same but for single spaces. A plain character, as most are, fails its first test.
UNEVEN_NOT_PLAIN = r"[^\p{Alnum}'](?:[^\p{Alnum}']+|(?<! ))"
TOKEN = f"[{WORD}]{{2,}}"
TWEET_TIME = "MMM dd HH:mm:ss Z yyyy"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    A lambda evaluates whatever it refers to once per element, and the optimizer
    inlines projected columns into it: without this, cleaning or lowering a text
    would run again for every phrase."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blank(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(" "))


def _blank_where(c: Column, found: Callable[[Column], Column], pattern: str) -> Column:
    """``_blank`` of the texts that a cheaper test finds: a replacement copies a text even if
    there is nothing to replace. ``found`` must hold wherever the pattern occurs."""
    return let(c, lambda t: F.when(found(t), _blank(t, pattern)).otherwise(t))


def _holds(*marks: str) -> Callable[[Column], Column]:
    return lambda t: reduce(or_, [F.contains(t, F.lit(m)) for m in marks])


def trim_text(c: Column | str) -> Column:
    """Strip leading and trailing whitespace of any kind."""
    return F.regexp_replace(_col(c), F.lit(EDGE_SPACES), F.lit(""))


def norm_id(c: Column | str, empty: bool = False) -> Column:
    """Trim an id and drop one trailing ``.0``; null stays null unless ``empty``."""
    out = F.regexp_replace(trim_text(_col(c).cast("string")), F.lit(r"\.0$"), F.lit(""))
    return F.coalesce(out, F.lit("")) if empty else out


def as_bool(c: Column | str) -> Column:
    """``true`` in any case is true; everything else, null included, is false."""
    return F.coalesce(F.lower(_col(c).cast("string")) == "true", F.lit(False))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def squash_ws(c: Column | str) -> Column:
    """Collapse whitespace runs to one space and trim; null becomes ''."""
    return squashed(text_or_empty(c))


def clean_basic(c: Column | str) -> Column:
    """Drop URLs and @mentions, squash whitespace, keep the case."""
    out = _blank_where(text_or_empty(c), _holds("://"), URL)
    return squash_ws(_blank_where(out, _holds("@"), MENTION))


def _keep_plain(c: Column) -> Column:
    out = _blank_where(c, lambda t: F.rlike(t, F.lit(RETWEET)), RETWEET)
    return plain(out)


def clean_topic(c: Column | str) -> Column:
    """Lowercase text for topic discovery: no links, mentions, entities or ``rt``."""
    out = F.lower(text_or_empty(c))
    for pattern, marks in ((URL_WWW_QUICK, _URL_MARKS), (MENTION, "@"), (ENTITY, "&")):
        out = _blank_where(out, _holds(*marks), pattern)
    return _keep_plain(out)


def clean_sampling(c: Column | str) -> Column:
    """Lowercase text for the v2 rules: like ``clean_topic`` but hashtags go and
    entities are not treated specially."""
    out = F.lower(text_or_empty(c))
    for pattern, marks in ((URL_WWW_QUICK, _URL_MARKS), (MENTION, "@"), (HASHTAG, "#")):
        out = _blank_where(out, _holds(*marks), pattern)
    return _keep_plain(out)


def n_words(c: Column | str) -> Column:
    """Number of whitespace-separated words (0 for an empty text)."""
    return F.regexp_count(text_or_empty(c), F.lit(NON_SPACES))


def more_words(c: Column | str, n: int) -> Column:
    """Whether ``n_words`` is above ``n``: a text is read up to its next word only."""
    return F.rlike(text_or_empty(c), F.lit(f"^[{WS}]*+(?:[^{WS}]++[{WS}]++){{{n}}}[^{WS}]"))


def is_useful(clean: Column | str) -> Column:
    """At least three words and five non-space characters, on cleaned text."""
    c = text_or_empty(clean)
    return more_words(c, 2) & (F.length(F.replace(c, F.lit(" "), F.lit(""))) >= 5)


def parse_ts(c: Column | str) -> Column:
    """Parse the dump's ``Tue Oct 31 22:10:47 +0000 2017`` form (or an ISO string);
    anything else is null. The weekday is cut off: Spark cannot parse it."""
    c = _col(c).cast("string")
    return F.coalesce(
        F.try_to_timestamp(F.substring(c, 5, 64), F.lit(TWEET_TIME)),
        F.try_to_timestamp(c),
    )


def urls(c: Column | str) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(URL), F.lit(0))


def preview(c: Column | str, n: int = 300) -> Column:
    return F.left(text_or_empty(c), F.lit(n))


def join_labels(labels: Column | str, sep: str = ", ") -> Column:
    return F.array_join(_col(labels), sep)


def n_flags(joined: Column | str, sep: str = "|") -> Column:
    """Number of labels in a joined list ('' holds none)."""
    c = text_or_empty(joined)
    seps = F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit("")))
    return F.when(c == "", F.lit(0)).otherwise((seps / len(sep)).cast("int") + 1)


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their bare form, from Unicode decomposition."""
    source, bare = [], []
    for code in range(0xC0, 0x250):
        ch = chr(code)
        stripped = "".join(
            x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)
        )
        if len(stripped) == 1 and stripped != ch:
            source.append(ch)
            bare.append(stripped)
    return "".join(source), "".join(bare)


def strip_accents(c: Column | str) -> Column:
    source, bare = _accent_table()
    return F.translate(_col(c), source, bare)


def tokens(c: Column | str) -> Column:
    """Lowercase runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(TOKEN), F.lit(0))


def with_bigrams(toks: Column | str) -> Column:
    """Tokens followed by the pairs of neighbouring tokens."""
    t = _col(toks)
    n = F.size(t)
    pairs = F.zip_with(
        F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(t, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(t, pairs)


def seeded_hash(seed: int, *keys: Column | str) -> Column:
    """A reproducible shuffle key: md5 of ``seed:key[:key..]``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))
