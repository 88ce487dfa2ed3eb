"""Auto-handle or escalate, and the drafted reply."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import rules as rl
from threadlens.functions import text as tx


def _two_places(c: Column) -> Column:
    return F.format_string("%.2f", c)


def gate_demo(
    message: Column, confidence: Column, similarity: Column,
    min_confidence: float = lx.DEMO_MIN_CONFIDENCE,
    min_similarity: float = lx.DEMO_MIN_SIMILARITY,
    risk: Sequence[str] = lx.DEMO_RISK, unresolved: Sequence[str] = lx.DEMO_UNRESOLVED,
    whole_word: bool = False,
) -> Column:
    """struct(action, reason). First that applies: risk term, low confidence, weak
    evidence (null counts as none), unresolved term; otherwise auto-handled.

    Terms hit inside longer words ("sue" in "issue") unless ``whole_word``."""
    text = F.lower(tx.text_or_empty(message))
    terms = F.struct(
        rl.first_match(text, risk, whole_word).alias("risk"),
        rl.first_match(text, unresolved, whole_word).alias("open"),
    )

    def decide(found: Column) -> Column:
        return _demo_decision(
            found["risk"], found["open"], confidence, similarity, min_confidence, min_similarity
        )

    return rl.let(terms, decide)


def _demo_decision(
    risk_term: Column, open_term: Column, confidence: Column, similarity: Column,
    min_confidence: float, min_similarity: float,
) -> Column:
    reason = (
        F.when(
            risk_term.isNotNull(),
            F.concat(F.lit("High-risk signal detected: '"), risk_term, F.lit("'.")),
        )
        .when(
            confidence < min_confidence,
            F.concat(F.lit("Low intent confidence ("), _two_places(confidence), F.lit(").")),
        )
        .when(F.coalesce(similarity, F.lit(0e0)) < min_similarity, F.lit(lx.DEMO_REASON_WEAK))
        .when(
            open_term.isNotNull(),
            F.concat(F.lit("Possible repeated/unresolved contact: '"), open_term, F.lit("'.")),
        )
        .otherwise(F.lit(lx.DEMO_REASON_AUTO))
    )
    escalate = (
        risk_term.isNotNull()
        | (confidence < min_confidence)
        | (F.coalesce(similarity, F.lit(0e0)) < min_similarity)
        | open_term.isNotNull()
    )
    action = F.when(escalate, F.lit("ESCALATE")).otherwise(F.lit("AUTO_HANDLE"))
    return F.struct(action.alias("action"), reason.alias("reason"))


def reply_demo(
    intent: Column, similarity: Column, case_intent: Column, case_reply: Column,
    min_similarity: float = lx.DEMO_MIN_SIMILARITY,
) -> Column:
    """A clarifying question when evidence is weak, a generic line when the best case
    has another intent, else that case's reply."""
    return (
        F.when(
            F.coalesce(similarity, F.lit(0e0)) < min_similarity, F.lit(lx.DEMO_REPLY_CLARIFY)
        )
        .when(~case_intent.eqNullSafe(intent), F.lit(lx.DEMO_REPLY_GENERIC))
        .otherwise(case_reply)
    )


def gate_final(
    message: Column, intent: Column, similarity: Column,
    min_similarity: float = lx.FINAL_MIN_SIMILARITY,
) -> Column:
    """struct(handling, reason) of the final gate."""
    text = F.lower(tx.text_or_empty(message))
    hits = F.struct(
        rl.contains_any(text, lx.FINAL_STRONG).alias("strong"),
        rl.contains_any(text, lx.FINAL_UNRESOLVED).alias("unresolved"),
    )
    return rl.let(
        hits,
        lambda h: _final_decision(h["strong"], h["unresolved"], intent, similarity, min_similarity),
    )


def _final_decision(
    strong: Column, unresolved: Column, intent: Column, similarity: Column,
    min_similarity: float,
) -> Column:
    checks = [
        (strong, "security"),
        ((intent == "account_access") & unresolved, "account"),
        (intent.isin("delivery", "order_status_tracking") & unresolved, "order"),
        (intent.isin("payment_billing", "return_refund_replacement") & unresolved, "money"),
        (intent == "customer_service_complaint", "complaint"),
        (F.coalesce(similarity, F.lit(0e0)) < min_similarity, "evidence"),
    ]
    reason = F.coalesce(
        *[F.when(test, F.lit(lx.FINAL_REASONS[name])) for test, name in checks],
        F.lit(lx.FINAL_REASONS["auto"]),
    )
    escalate = reduce(or_, [F.coalesce(test, F.lit(False)) for test, _ in checks])
    handling = F.when(escalate, F.lit("ESCALATE")).otherwise(F.lit("AUTO-HANDLE"))
    return F.struct(handling.alias("handling"), reason.alias("reason"))


def choose_action(response: Column | str) -> Column:
    """What a past response did, by the first matching step."""
    return rl.cascade(F.lower(tx.text_or_empty(response)), lx.FINAL_ACTIONS, "information")


def reply_final(
    intent: Column, evidence_response: Column, escalate: Column,
    brand: str = "support", company: str = "brand",
) -> Column:
    """Template by intent, the first link of the evidence, and the routing sentence."""
    base = F.coalesce(
        *[F.when(intent == k, F.lit(v)) for k, v in lx.FINAL_REPLIES.items()],
        F.lit(lx.FINAL_REPLY_DEFAULT.format(brand=brand, company=company)),
    )
    link = F.nullif(F.regexp_substr(tx.text_or_empty(evidence_response), F.lit(tx.URL)), F.lit(""))
    return F.concat(
        base,
        F.coalesce(F.concat(F.lit(lx.FINAL_REPLY_URL), link), F.lit("")),
        F.when(escalate, F.lit(lx.FINAL_REPLY_ROUTED)).otherwise(F.lit("")),
    )
