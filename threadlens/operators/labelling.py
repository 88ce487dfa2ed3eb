"""Phrase-rule labels on messages, context and responses.

Each function adds columns to a contextual table. Cleaned text is computed first,
once, and the labels then read it; ``parts`` limits the work to the labels needed.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import rules as rl
from threadlens.functions import text as tx

MESSAGE = "current_customer_message"
CONTEXT = "conversation_context"
RESPONSE = "historical_brand_response"


def drop_speakers(context: Column, speakers: list[str]) -> Column:
    """Remove the ``Speaker: `` prefixes of a rendered context."""
    names = "|".join(speakers)
    return F.regexp_replace(context, F.lit(f"(?m)^(?:{names}): "), F.lit(""))


def _context(speakers: list[str] | None) -> Column:
    text = tx.text_or_empty(CONTEXT)
    return drop_speakers(text, speakers) if speakers else text


def _cleaned(
    clean: Callable[[Column], Column], speakers: list[str] | None
) -> dict[str, Column]:
    """The cleaned message as ``__cur``, and as ``__pre`` the cleaned context without the
    message, if that is what it ends with, as a rendered context does: a message is cleaned
    once. ``__tail`` says whether it was taken off.

    It is taken off behind a space or a line break only. Whatever is cleaned away ends at
    spaces, so cleaning the two apart and joining them by a space gives the same."""
    message, context = tx.text_or_empty(MESSAGE), _context(speakers)

    def ends(c: Column, *before: str) -> Column:
        return reduce(or_, [F.endswith(c, F.concat(F.lit(b), message)) for b in before])

    tail = (context == message) | ends(context, " ", "\n")
    rest = F.when(tail, F.left(context, F.length(context) - F.length(message))).otherwise(context)
    return {"__cur": clean(message), "__pre": clean(rest), "__tail": tail}


def _joined(*texts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *texts))


def _whole_context() -> Column:
    return F.when(F.col("__tail"), _joined(F.col("__pre"), F.col("__cur"))).otherwise(
        F.col("__pre")
    )


def _seam(text: Column, width: int, pre: Column) -> Column:
    """What to read besides ``text`` for the phrases in ``pre`` and ``text`` together: those
    not in ``text`` alone begin before it and reach less than ``width`` into it."""
    return _joined(pre, F.left(text, F.lit(width)))


def _pick(parts: Sequence[str], known: Mapping[str, Mapping[str, Column]]) -> dict[str, Column]:
    return {name: c for part in parts for name, c in known[part].items()}


def _check(parts: Sequence[str], known: Sequence[str]) -> None:
    unknown = [p for p in parts if p not in known]
    if unknown or not parts:
        raise ValueError(f"unknown parts {unknown}; choose from {list(known)}")


def _needed(parts: Sequence[str], **texts: tuple[Column, Sequence[str]]) -> dict[str, Column]:
    """The staged texts that any of the wanted parts reads."""
    return {name: c for name, (c, users) in texts.items() if set(users) & set(parts)}


def _looked_up(
    df: DataFrame, parts: Collection[str], **texts: Mapping[str, Sequence[Sequence[str]]]
) -> DataFrame:
    """Add ``__hits``: per staged text the hits of the rule sets that the wanted parts need,
    by part, all found in one reading of the text."""
    wanted = {
        text: {part: groups for part, groups in sets.items() if part in parts}
        for text, sets in texts.items()
    }
    hits = [rl.lookup(F.col(text), sets).alias(text) for text, sets in wanted.items() if sets]
    return rl.computed(df, {"__hits": F.struct(*hits)}) if hits else df


# -- analysis rule set -------------------------------------------------------


def analysis_text(speakers: list[str] | None = None) -> Column:
    joined = F.concat(_context(speakers), F.lit(" "), tx.text_or_empty(MESSAGE))
    return F.lower(tx.clean_basic(joined))


def label_analysis(
    df: DataFrame, parts: Sequence[str] = ("intent", "action", "signals", "ambiguous"),
    speakers: list[str] | None = None,
) -> DataFrame:
    """Labels of the analysis rule set, by part:

    intent: candidate_intent (priority cascade over context and message);
    action: historical_action (most hits in the response);
    signals: escalation_signals, potential_escalation;
    ambiguous: potentially_ambiguous.

    With ``speakers`` the prefixes of the rendered context do not count as text."""
    _check(parts, ("intent", "action", "signals", "ambiguous"))
    from_both = ("intent", "signals")
    cleaned = _cleaned(tx.clean_basic, speakers)
    staged = rl.computed(
        df,
        _needed(
            parts,
            **{
                name: (F.lower(c) if name != "__tail" else c, (*from_both, "ambiguous"))
                for name, c in cleaned.items()
                if name == "__cur" or set(from_both) & set(parts)
            },
            __resp=(F.lower(tx.clean_basic(RESPONSE)), ("action",)),
        ),
    )
    both = {"intent": [*lx.ANALYSIS_INTENTS.values()], "signals": [*lx.ANALYSIS_SIGNALS.values()]}
    if set(from_both) & set(parts):
        # As ``analysis_text``: the context, a space and the message, which the context may end
        # with. Phrases in the message are looked up there; the seams hold all others.
        cur, pre = F.col("__cur"), F.col("__pre")
        width = rl.longest(both.values())
        seams = F.concat(
            _seam(cur, width, pre), F.lit("\n"), F.right(cur, F.lit(width)), F.lit(" "),
            F.left(cur, F.lit(width)),
        )
        short = F.length(cur) <= width
        edge = (
            F.when(~F.col("__tail"), _seam(cur, width, pre))
            .when(short, _joined(pre, cur, cur)).otherwise(seams)
        )
        staged = rl.computed(staged, {"__edge": edge})
    staged = _looked_up(
        staged, parts,
        __cur={**both, "ambiguous": [lx.ANALYSIS_AMBIGUOUS]},
        __edge=both,
        __resp={"action": [*lx.ANALYSIS_ACTIONS.values()]},
    )
    hits = F.col("__hits")

    def in_both(part: str) -> Column:
        return F.zip_with(
            hits["__cur"][part], hits["__edge"][part], lambda a, b: F.concat(a, b)
        )

    labels = _pick(
        parts,
        {
            "intent": {
                "candidate_intent": rl.first_hit(
                    in_both("intent"), lx.ANALYSIS_INTENTS, "other"
                )
            },
            "action": {
                "historical_action": rl.label_of(
                    rl.most_hits(hits["__resp"]["action"], lx.ANALYSIS_ACTIONS), "other"
                )
            },
            "signals": {
                "escalation_signals": rl.hit_labels(in_both("signals"), lx.ANALYSIS_SIGNALS)
            },
            "ambiguous": {
                "potentially_ambiguous": ~tx.more_words("__cur", 5)
                | rl.any_hit(hits["__cur"]["ambiguous"])
            },
        },
    )
    out = rl.computed(staged, labels).drop(
        "__cur", "__pre", "__tail", "__resp", "__edge", "__hits"
    )
    if "signals" in parts:
        out = out.withColumn("potential_escalation", F.size("escalation_signals") > 0)
    return out


# -- candidate rule set v1 ---------------------------------------------------


def label_v1(
    df: DataFrame, parts: Sequence[str] = ("intent", "action", "signals", "ambiguity"),
    speakers: list[str] | None = None,
) -> DataFrame:
    """Labels of the first candidate rule set, by part:

    intent: candidate_intent; action: candidate_action;
    signals: signals (array) and escalation_signals (joined by a bar);
    ambiguity: ambiguity_score."""
    _check(parts, ("intent", "action", "signals", "ambiguity"))
    from_both = ("intent", "signals", "ambiguity")
    staged = rl.computed(
        df,
        _needed(
            parts,
            **{name: (c, from_both) for name, c in _cleaned(tx.clean_basic, speakers).items()},
            __resp=(F.lower(tx.clean_basic(RESPONSE)), ("action",)),
        ),
    )
    if set(from_both) & set(parts):
        staged = rl.computed(staged, {"__ctx": _whole_context()})
    cur, ctx = F.col("__cur"), F.col("__ctx")
    more = _needed(
        parts,
        __both=(F.lower(F.concat(cur, F.lit(" "), ctx)), ("intent", "signals")),
    )
    staged = rl.computed(staged, more) if more else staged
    staged = _looked_up(
        staged, parts,
        __both={"intent": [*lx.V1_INTENTS.values()], "signals": [*lx.V1_SIGNALS.values()]},
        __resp={"action": [*lx.V1_ACTIONS.values()]},
    )
    hits = F.col("__hits")
    deictic = F.arrays_overlap(F.split(F.lower(cur), " "), rl.phrase_list(lx.V1_DEICTIC))
    labels = _pick(
        parts,
        {
            "intent": {
                "candidate_intent": rl.label_of(
                    rl.most_hits(hits["__both"]["intent"], lx.V1_INTENTS), "information"
                )
            },
            "action": {
                "candidate_action": rl.label_of(
                    rl.most_hits(hits["__resp"]["action"], lx.V1_ACTIONS), "other"
                )
            },
            "signals": {"signals": rl.hit_labels(hits["__both"]["signals"], lx.V1_SIGNALS)},
            "ambiguity": {
                "ambiguity_score": F.when(~tx.more_words(cur, 3), 2)
                .when(~tx.more_words(cur, 6), 1).otherwise(0)
                + F.when(deictic, 2).otherwise(0)
                + F.when(F.length(ctx) > 150, 1).otherwise(0)
            },
        },
    )
    out = rl.computed(staged, labels).drop(
        "__cur", "__pre", "__tail", "__ctx", "__resp", "__both", "__hits"
    )
    if "signals" in parts:
        out = out.withColumn("escalation_signals", tx.join_labels("signals", "|"))
    return out


# -- candidate rule set v2 ---------------------------------------------------


def ranked_intents_v2(message: Column, context: Column) -> Column:
    """All intents as structs, best first: score = 2 x message hits + context hits."""
    return rl.ranked(lx.V2_INTENTS, [message, context], [2, 1])


def _matches_of(label: Column, first: Column, second: Column, top: int = 5) -> Column:
    """First ``top`` message hits then first ``top`` context hits of the label at hand."""
    def shown(i: int) -> Column:
        return F.array_join(F.concat(*(F.slice(h[i], 1, top) for h in (first, second))), "; ")

    return F.coalesce(*[F.when(label == name, shown(i)) for i, name in enumerate(lx.V2_INTENTS)])


def intent_v2(best: Column, margin: Column) -> Column:
    return (
        F.when(best["score"] == 0, F.lit("unknown"))
        .when((best["score"] <= 2) & (margin <= 1), F.lit("ambiguous"))
        .otherwise(best["label"])
    )


def flags_v2(message: Column, context: Column) -> Column:
    unresolved = rl.contains_any(message, lx.V2_UNRESOLVED_MESSAGE)
    known = rl.contains_any(context, lx.V2_SUPPORT_CONTEXT)
    return _flags_v2(rl.signals(message, lx.V2_FLAGS), unresolved & known)


def _flags_v2(signals: Column, contextual: Column) -> Column:
    flag = F.when(contextual, F.lit(lx.V2_CONTEXTUAL_FLAG))
    return F.array_compact(F.concat(signals, F.array(flag)))


def ambiguity_reasons_v2(message: Column, context: Column, best_score: Column,
                         margin: Column) -> Column:
    """Each reason that applies is worth two points."""
    deictic = F.rlike(message, F.lit(r"\b(?:" + "|".join(lx.V2_DEICTIC) + r")\b"))
    return F.array_compact(
        F.array(
            F.when(~tx.more_words(message, 4), F.lit("short_message")),
            F.when(deictic, F.lit("deictic_reference")),
            F.when(
                ~tx.more_words(message, 8) & tx.more_words(context, 15),
                F.lit("context_dependent"),
            ),
            F.when((best_score > 0) & (margin <= 1), F.lit("competing_intents")),
        )
    )


def label_v2(
    df: DataFrame, parts: Sequence[str] = ("intent", "action", "flags", "ambiguity"),
    speakers: list[str] | None = None, cleaned: str | None = None,
) -> DataFrame:
    """Labels of the second candidate rule set, by part. Lists stay arrays. ``cleaned``
    names a column that keeps the cleaned message.

    intent: candidate_intent, candidate_score, candidate_second_score,
    candidate_margin, candidate_matches; action: candidate_action,
    candidate_action_matches; flags: escalation_flags, escalation_candidate;
    ambiguity: ambiguity_reasons, ambiguity_score, ambiguity_candidate."""
    _check(parts, ("intent", "action", "flags", "ambiguity"))
    cur, ctx = F.col("__cur"), F.col("__ctx")
    known = {"intent": [*lx.V2_INTENTS.values()], "flags": [lx.V2_SUPPORT_CONTEXT]}
    out = rl.computed(df, _cleaned(tx.clean_sampling, speakers))
    # Phrases of the context that the message holds are looked up there only.
    seam = _seam(cur, rl.longest(known.values()), F.col("__pre"))
    out = rl.computed(
        out,
        {
            "__ctx": _whole_context(),
            "__edge": F.when(F.col("__tail"), seam).otherwise(F.col("__pre")),
        },
    )
    if "action" in parts:
        out = rl.computed(out, {"__both": F.concat(cur, F.lit(" "), ctx)})
    # Intent and ambiguity both read the scores of the intents.
    wanted = {*parts, *(["intent"] if "ambiguity" in parts else [])}
    wanted |= {"unresolved", "known"} if "flags" in parts else set()
    out = _looked_up(
        out, wanted,
        __cur={
            "intent": known["intent"], "flags": [*lx.V2_FLAGS.values()],
            "unresolved": [lx.V2_UNRESOLVED_MESSAGE], "known": known["flags"],
        },
        __edge=known,
        __both={"action": [*lx.V2_ACTIONS.values()]},
    )
    hits = F.col("__hits")
    first, acted = hits["__cur"]["intent"], hits["__both"]["action"]
    if "intent" in wanted:
        of_tail = rl.either(first, hits["__edge"]["intent"], known["intent"])
        out = rl.computed(
            out,
            {"__second": F.when(F.col("__tail"), of_tail).otherwise(hits["__edge"]["intent"])},
        )
    second_hits = F.col("__second")
    in_context = rl.any_hit(hits["__edge"]["flags"]) | (
        F.col("__tail") & rl.any_hit(hits["__cur"]["known"])
    )
    scores: dict[str, Column] = {}
    if "intent" in wanted:
        scores["__ranked"] = rl.ranked_hits(lx.V2_INTENTS, [first, second_hits], [2, 1])
    if "action" in parts:
        scores["__action"] = rl.most_hits(acted, lx.V2_ACTIONS)
    if scores:
        out = rl.computed(out, scores)
    best, second = F.col("__ranked")[0], F.col("__ranked")[1]
    margin = best["score"] - second["score"]
    action = F.col("__action")
    labels = _pick(
        parts,
        {
            "intent": {
                "candidate_intent": intent_v2(best, margin),
                "candidate_score": best["score"],
                "candidate_second_score": second["score"],
                "candidate_margin": margin,
                "candidate_matches": _matches_of(best["label"], first, second_hits),
            },
            "action": {
                "candidate_action": F.when(action["score"] > 0, action["label"]).otherwise(
                    F.lit("unknown")
                ),
                "candidate_action_matches": F.when(
                    action["score"] > 0,
                    F.coalesce(
                        *[
                            F.when(action["label"] == name, acted[i])
                            for i, name in enumerate(lx.V2_ACTIONS)
                        ]
                    ),
                ).otherwise(F.array().cast("array<string>")),
            },
            "flags": {
                "escalation_flags": _flags_v2(
                    rl.hit_labels(hits["__cur"]["flags"], lx.V2_FLAGS),
                    rl.any_hit(hits["__cur"]["unresolved"]) & in_context,
                )
            },
            "ambiguity": {
                "ambiguity_reasons": ambiguity_reasons_v2(cur, ctx, best["score"], margin)
            },
        },
    )
    out = rl.computed(out, labels).drop(
        "__pre", "__tail", "__ctx", "__edge", "__hits", "__second", "__ranked", "__both", "__action"
    )
    out = out.withColumnRenamed("__cur", cleaned) if cleaned else out.drop("__cur")
    if "flags" in parts:
        out = out.withColumn("escalation_candidate", F.size("escalation_flags") > 0)
    if "ambiguity" in parts:
        out = out.withColumns(
            {
                "ambiguity_score": F.size("ambiguity_reasons") * 2,
                "ambiguity_candidate": F.size("ambiguity_reasons") >= 2,
            }
        )
    return out


def sampling_reason() -> Column:
    return F.coalesce(
        F.nullif(
            F.concat_ws(
                ";",
                F.when(F.col("ambiguity_candidate"), F.lit("ambiguous")),
                F.when(F.col("escalation_candidate"), F.lit("escalation")),
                F.when(F.col("context_turn_count") >= 2, F.lit("context_heavy")),
            ),
            F.lit(""),
        ),
        F.lit("balanced_intent"),
    )


# -- silver labels -----------------------------------------------------------


def silver_intent(text: Column | str) -> Column:
    return rl.cascade(F.lower(tx.text_or_empty(text)), lx.SILVER_INTENTS, "unknown")


def usable_silver(pairs: DataFrame) -> DataFrame:
    """Pairs with a silver label other than ``unknown``."""
    return pairs.withColumn("silver_intent", silver_intent("customer_text")).where(
        F.col("silver_intent") != "unknown"
    )
