"""Phrase rules compiled to Column expressions.

Matching is substring containment on lowered text, as the rule sets expect
("eta" does hit inside a longer word). ``whole_word=True`` asks for word
boundaries instead. All phrases of a rule set are looked up in one reading of a text
(``phrases.found``, an Arrow UDF); labels, counts and orders are Column expressions on
the few phrases found. A plan grows with the labels, not with the phrases.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.phrases import found
from threadlens.functions.text import let

Rules = Mapping[str, Sequence[str]]


def computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that later filters must not re-evaluate.

    A filter on a projected column is pushed below the projection with the whole
    expression copied into it, once per use. For long phrase rules over cleaned text
    those copies multiply. A one-element ``inline`` keeps the values: filters on them
    stay above it, filters on other columns still move down."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def phrase_list(phrases: Sequence[str]) -> Column:
    """The phrases as one literal array (folded at planning; a lit per phrase would
    cost a driver round trip each)."""
    return F.split(F.lit("\n".join(phrases)), "\n")


def _some(hits: Column) -> Column:
    """Whether there are any; null for a null text."""
    return F.array_size(hits) > 0


def _n(hits: Column) -> Column:
    return F.coalesce(F.array_size(hits), F.lit(0))


def _any_word(t: Column, phrases: Sequence[str]) -> Column:
    words = "|".join(re.escape(p) for p in phrases)
    return F.rlike(t, F.lit(rf"(?U)\b(?:{words})\b"))


def _scored(score_of: Callable[[int], Column], rules: Rules) -> Column:
    return F.array(
        *[
            F.struct(score_of(i).alias("score"), F.lit(-i).alias("neg_ord"), F.lit(label).alias("label"))
            for i, label in enumerate(rules)
        ]
    )


def lookup(text: Column, sets: Mapping[str, Sequence[Sequence[str]]]) -> Column:
    """The hits of several rule sets in one reading of ``text``: a struct with the hits of
    each set, an array per group of phrases. Stage it (``computed``) and hand its fields to
    ``first_hit``, ``most_hits``, ``hit_labels``, ``ranked_hits`` and ``any_hit``."""
    groups = [g for of_set in sets.values() for g in of_set]
    starts, at = {}, 1
    for name, of_set in sets.items():
        starts[name], at = at, at + len(of_set)
    return let(
        found(text, groups),
        lambda h: F.struct(
            *(F.slice(h, starts[name], len(of_set)).alias(name) for name, of_set in sets.items())
        ),
    )


def longest(sets: Iterable[Sequence[Sequence[str]]]) -> int:
    """The length of the longest phrase of the sets."""
    return max(len(p) for of_set in sets for group in of_set for p in group)


def either(hits: Column, more: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Per group the phrases hit in one of two texts, in table order."""
    return F.array(
        *[
            F.when(F.array_size(more[i]) == 0, hits[i]).otherwise(
                let(
                    F.concat(hits[i], more[i]),
                    lambda h: F.filter(phrase_list(g), lambda p: F.array_contains(h, p)),
                )
            )
            for i, g in enumerate(groups)
        ]
    )


def any_hit(hits: Column) -> Column:
    """Whether any group was hit; null for a null text."""
    return _some(F.flatten(hits))


def first_hit(hits: Column, rules: Rules, default: str) -> Column:
    """The first label, in table order, with any hit."""
    steps = [F.when(_some(hits[i]), F.lit(k)) for i, k in enumerate(rules)]
    return F.coalesce(*steps, F.lit(default))


def most_hits(hits: Column, rules: Rules) -> Column:
    """struct(score, neg_ord, label) of the label with most hits, see ``best_by_count``."""
    return F.array_max(_scored(lambda i: _n(hits[i]), rules))


def hit_labels(hits: Column, rules: Rules) -> Column:
    """All labels with any hit, in table order, as ARRAY<STRING>."""
    return F.array_compact(
        F.array(*[F.when(_some(hits[i]), F.lit(label)) for i, label in enumerate(rules)])
    )


def ranked_hits(rules: Rules, hits: Sequence[Column], factors: Sequence[int]) -> Column:
    """All labels as structs, best first; the score adds up the hits in the texts, each
    times its factor."""
    def score(i: int) -> Column:
        first, *more = (_n(h[i]) * f for h, f in zip(hits, factors))
        return sum(more, first)

    return F.sort_array(_scored(score, rules), asc=False)


def label_of(best: Column, default: str) -> Column:
    """The label of ``most_hits``; no hit gives ``default``."""
    return F.when(best["score"] > 0, best["label"]).otherwise(F.lit(default))


def contains_any(text: Column, phrases: Sequence[str], whole_word: bool = False) -> Column:
    """``text`` must already be lowered and not null."""
    if whole_word:
        return let(text, lambda t: _any_word(t, phrases))
    return let(found(text, [phrases]), lambda h: _some(h[0]))


def matches(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur, in table order, as ARRAY<STRING>."""
    none = F.array().cast("array<string>")
    return let(found(text, [phrases]), lambda h: F.coalesce(h[0], none))


def match_count(text: Column, phrases: Sequence[str]) -> Column:
    return F.size(matches(text, phrases))


def first_match(text: Column, phrases: Sequence[str], whole_word: bool = False) -> Column:
    """The first phrase of the table that occurs, else null."""
    if not whole_word:
        return F.try_element_at(matches(text, phrases), F.lit(1))
    return let(
        text, lambda t: F.coalesce(*[F.when(_any_word(t, [p]), F.lit(p)) for p in phrases])
    )


def cascade(text: Column, rules: Rules, default: str, whole_word: bool = False) -> Column:
    """The first label, in table order, with any hit."""
    if whole_word:
        return let(
            text,
            lambda t: F.coalesce(
                *[F.when(_any_word(t, rules[k]), F.lit(k)) for k in rules], F.lit(default)
            ),
        )
    return let(found(text, [*rules.values()]), lambda h: first_hit(h, rules, default))


def best_by_count(text: Column, rules: Rules) -> Column:
    """struct(score, neg_ord, label) of the label with most hits. Comparing such
    structs puts the higher score first and, on a tie, the label declared first."""
    return let(found(text, [*rules.values()]), lambda h: most_hits(h, rules))


def ranked(
    rules: Rules, texts: Sequence[Column], factors: Sequence[int]
) -> Column:
    """All labels as structs, best first; the score adds up the hits in two texts,
    each times its factor."""
    first, second = (found(t, [*rules.values()]) for t in texts)
    return let(
        F.struct(first.alias("first"), second.alias("second")),
        lambda h: ranked_hits(rules, [h["first"], h["second"]], factors),
    )


def label_by_count(text: Column, rules: Rules, default: str) -> Column:
    """The label with most hits; the first declared wins a tie, none gives ``default``."""
    return let(best_by_count(text, rules), lambda best: label_of(best, default))


def signals(text: Column, rules: Rules) -> Column:
    """All labels with any hit, in table order, as ARRAY<STRING>."""
    return let(found(text, [*rules.values()]), lambda h: hit_labels(h, rules))
