"""SQL building blocks for the checks: expressions and common table expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from threadlens.functions import lexicons as lx
from threadlens.functions import text as tx
from threadlens.suite.fixtures import BRAND, BRAND_PHRASES, USER_PHRASES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(items: Sequence[str]) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def sub(x: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, tx.EDGE_SPACES, "")


def norm_id(x: str) -> str:
    return sub(strip(x), r"\.0$", "")


def squash(x: str) -> str:
    return f"trim({sub(f'coalesce({x}, {lit(str())})', tx.SPACES)})"


def clean_basic(x: str) -> str:
    return squash(sub(sub(x, tx.URL), tx.MENTION))


NOT_PLAIN = "[^a-z0-9']+"
_RT = f"(^|[^{tx.WORD}])rt($|[^{tx.WORD}])"


def _plain(x: str) -> str:
    twice = sub(sub(x, _RT, r"\1 \2"), _RT, r"\1 \2")
    return f"trim({sub(twice, NOT_PLAIN)})"


def clean_topic(x: str) -> str:
    return _plain(sub(sub(sub(f"lower({x})", tx.URL_WWW), tx.MENTION), tx.ENTITY))


def clean_sampling(x: str) -> str:
    return _plain(sub(sub(sub(f"lower({x})", tx.URL_WWW), tx.MENTION), tx.HASHTAG))


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(tx.NON_SPACES)}))::INTEGER"


def hits(x: str, phrases: Sequence[str]) -> str:
    return f"list_filter({lits(phrases)}, lambda p: contains({x}, p))"


def any_of(x: str, phrases: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in phrases) + ")"


def count_of(x: str, phrases: Sequence[str]) -> str:
    return f"len({hits(x, phrases)})"


def scores(x: str, rules: Mapping[str, Sequence[str]]) -> str:
    return "[" + ", ".join(count_of(x, p) for p in rules.values()) + "]"


def best_label(scores_col: str, labels: Sequence[str], default: str) -> str:
    return (
        f"CASE WHEN list_max({scores_col}) = 0 THEN {lit(default)} "
        f"ELSE {lits(labels)}[list_position({scores_col}, list_max({scores_col}))] END"
    )


def cascade(x: str, rules: Mapping[str, Sequence[str]], default: str) -> str:
    whens = " ".join(f"WHEN {any_of(x, p)} THEN {lit(k)}" for k, p in rules.items())
    return f"CASE {whens} ELSE {lit(default)} END"


def signals(x: str, rules: Mapping[str, Sequence[str]]) -> str:
    each = ", ".join(f"CASE WHEN {any_of(x, p)} THEN {lit(k)} END" for k, p in rules.items())
    return f"list_filter([{each}], lambda s: s IS NOT NULL)"


def joined(x: str, sep: str) -> str:
    return f"coalesce(array_to_string({x}, {lit(sep)}), '')"


def seeded(seed: int, *keys: str) -> str:
    return f"md5('{seed}:' || " + " || ':' || ".join(keys) + ")"


def text_time(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


_AT = "(conv_id * 31 + turn * 7)"
TWEETS = f"""tweets AS (
  SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS tweet_id,
    CASE role WHEN 'assistant' THEN '{BRAND}' WHEN 'system' THEN 'system'
      ELSE 'c' || CAST(conv_id // 3 AS VARCHAR) END AS author_id,
    role <> 'assistant' AS inbound,
    TIMESTAMP '2017-10-31 22:00:00' + to_seconds(conv_id * 60 + turn) AS created_at,
    text || ' ' || CASE WHEN role = 'assistant'
      THEN {lits(BRAND_PHRASES)}[1 + {_AT} % {len(BRAND_PHRASES)}]
      ELSE {lits(USER_PHRASES)}[1 + {_AT} % {len(USER_PHRASES)}] END AS text,
    CAST(conv_id * 100 + turn + 1 AS VARCHAR) AS response_tweet_id,
    CASE WHEN turn > 0 THEN CAST(conv_id * 100 + turn - 1 AS VARCHAR) END
      AS in_response_to_tweet_id
  FROM conversations)"""

EVENT_TWEETS = f"""tweets AS (
  SELECT CAST(event_id AS VARCHAR) AS tweet_id,
    CASE WHEN event_type = 'purchase' THEN '{BRAND}'
      ELSE 'u' || CAST(user_id AS VARCHAR) END AS author_id,
    event_type <> 'purchase' AS inbound, ts AS created_at,
    event_type || ' ' || props AS text, CAST(NULL AS VARCHAR) AS response_tweet_id,
    CASE WHEN event_type <> 'signup' THEN CAST(event_id
      - CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS VARCHAR) END
      AS in_response_to_tweet_id
  FROM events)"""

PAIRS = f"""pairs AS (
  SELECT p.tweet_id AS customer_tweet_id, r.tweet_id AS brand_tweet_id,
    p.author_id AS customer_author_id, p.text AS customer_text, r.text AS brand_response,
    p.created_at AS customer_created_at, r.created_at AS brand_created_at,
    p.response_tweet_id AS customer_response_tweet_id,
    r.in_response_to_tweet_id AS brand_in_response_to,
    p.in_response_to_tweet_id AS customer_in_response_to
  FROM tweets r JOIN tweets p ON r.in_response_to_tweet_id = p.tweet_id
  WHERE r.author_id = '{BRAND}' AND NOT r.inbound AND p.author_id <> '{BRAND}')"""


def _line(author: str, text: str) -> str:
    return (
        f"CASE WHEN {squash(text)} <> '' THEN CASE WHEN {author} = '{BRAND}' "
        f"THEN '{BRAND}' ELSE 'Customer' END || ': ' || {squash(text)} END"
    )


# The chain as a recursive query: another route than the library's joins.
CHAIN = f"""walk AS (
  SELECT brand_tweet_id, customer_tweet_id, 0 AS hop, customer_tweet_id AS id,
    [customer_tweet_id] AS visited
  FROM pairs
  UNION ALL
  SELECT w.brand_tweet_id, w.customer_tweet_id, w.hop + 1, u.tweet_id,
    list_append(w.visited, u.tweet_id)
  FROM walk w JOIN tweets t ON t.tweet_id = w.id
    JOIN tweets u ON u.tweet_id = t.in_response_to_tweet_id
  WHERE w.hop < 2 AND NOT list_contains(w.visited, u.tweet_id)),
lines AS (
  SELECT w.brand_tweet_id, w.customer_tweet_id, w.hop, {_line('t.author_id', 't.text')} AS line
  FROM walk w JOIN tweets t ON t.tweet_id = w.id),
chain AS (
  SELECT p.customer_tweet_id, p.brand_tweet_id, any_value(p.customer_author_id) AS customer_author_id,
    any_value({squash('p.customer_text')}) AS current_customer_message,
    any_value({squash('p.brand_response')}) AS historical_brand_response,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.hop DESC), '') AS conversation_context,
    CAST(count(l.line) AS INTEGER) AS context_turn_count,
    any_value(p.customer_created_at) AS customer_created_at,
    any_value(p.brand_created_at) AS brand_created_at
  FROM pairs p LEFT JOIN lines l USING (brand_tweet_id, customer_tweet_id)
  GROUP BY p.customer_tweet_id, p.brand_tweet_id)"""

_DOC_MSG = squash(f"text || ' ' || {lits(USER_PHRASES)}[1 + (doc_id * 31) % {len(USER_PHRASES)}]")
_DOC_REPLY = squash(f"{lits(BRAND_PHRASES)}[1 + (doc_id * 31) % {len(BRAND_PHRASES)}]")
DOC_MESSAGES = f"""doc_messages AS (
  SELECT 'd' || doc_id AS customer_tweet_id, 'r' || doc_id AS brand_tweet_id,
    'a' || source AS customer_author_id, {_DOC_MSG} AS current_customer_message,
    {_DOC_REPLY} AS historical_brand_response,
    'Customer: ' || {_DOC_MSG} AS conversation_context, 1::INTEGER AS context_turn_count,
    TIMESTAMP '2020-09-13 12:26:40' + to_seconds(doc_id) AS customer_created_at,
    TIMESTAMP '2020-09-13 12:26:41' + to_seconds(doc_id) AS brand_created_at
  FROM documents)"""

CONTEXTUAL = f"""{TWEETS}, {PAIRS}, {CHAIN}, {DOC_MESSAGES},
contextual AS (SELECT * FROM chain UNION ALL BY NAME SELECT * FROM doc_messages)"""

SILVER = cascade("lower(customer_text)", lx.SILVER_INTENTS, "unknown")

# -- labelled tables ----------------------------------------------------------

_MSG, _CTX, _RESP = (
    "current_customer_message", "conversation_context", "historical_brand_response",
)
ANALYSIS = f"""a0 AS (
  SELECT *, lower({clean_basic(f"{_CTX} || ' ' || {_MSG}")}) AS both_text,
    lower({clean_basic(_RESP)}) AS resp, lower({clean_basic(_MSG)}) AS msg
  FROM contextual),
a1 AS (SELECT *, {scores('resp', lx.ANALYSIS_ACTIONS)} AS s FROM a0),
analysis AS (
  SELECT *, {cascade('both_text', lx.ANALYSIS_INTENTS, 'other')} AS candidate_intent,
    {best_label('s', list(lx.ANALYSIS_ACTIONS), 'other')} AS historical_action,
    {signals('both_text', lx.ANALYSIS_SIGNALS)} AS sig,
    {n_words('msg')} <= 5 OR {any_of('msg', lx.ANALYSIS_AMBIGUOUS)} AS potentially_ambiguous
  FROM a1)"""

V1 = f"""b0 AS (
  SELECT *, {clean_basic(_MSG)} AS cur, {clean_basic(_CTX)} AS ctx,
    lower({clean_basic(_RESP)}) AS resp
  FROM contextual),
b1 AS (SELECT *, lower(cur || ' ' || ctx) AS both_text FROM b0),
b2 AS (SELECT *, {scores('both_text', lx.V1_INTENTS)} AS si,
    {scores('resp', lx.V1_ACTIONS)} AS sa FROM b1),
v1 AS (
  SELECT *, {best_label('si', list(lx.V1_INTENTS), 'information')} AS candidate_intent,
    {best_label('sa', list(lx.V1_ACTIONS), 'other')} AS candidate_action,
    {signals('both_text', lx.V1_SIGNALS)} AS sig,
    (CASE WHEN {n_words('cur')} <= 3 THEN 2 WHEN {n_words('cur')} <= 6 THEN 1 ELSE 0 END
     + CASE WHEN list_has_any(string_split(lower(cur), ' '), {lits(lx.V1_DEICTIC)})
         THEN 2 ELSE 0 END
     + CASE WHEN length(ctx) > 150 THEN 1 ELSE 0 END)::INTEGER AS ambiguity_score
  FROM b2)"""

_V2_SCORES = "[" + ", ".join(
    f"2 * {count_of('cur', p)} + {count_of('ctx', p)}" for p in lx.V2_INTENTS.values()
) + "]"
_V2_FLAGS = "list_filter([" + ", ".join(
    [f"CASE WHEN {any_of('cur', p)} THEN {lit(k)} END" for k, p in lx.V2_FLAGS.items()]
    + [
        f"CASE WHEN {any_of('cur', lx.V2_UNRESOLVED_MESSAGE)} AND "
        f"{any_of('ctx', lx.V2_SUPPORT_CONTEXT)} THEN {lit(lx.V2_CONTEXTUAL_FLAG)} END"
    ]
) + "], lambda s: s IS NOT NULL)"
_V2_MATCHES = "CASE best_label " + " ".join(
    f"WHEN {lit(k)} THEN list_concat(list_slice({hits('cur', p)}, 1, 5), "
    f"list_slice({hits('ctx', p)}, 1, 5))"
    for k, p in lx.V2_INTENTS.items()
) + " END"
_V2_ACTION_MATCHES = "CASE candidate_action " + " ".join(
    f"WHEN {lit(k)} THEN {hits('both_text', p)}" for k, p in lx.V2_ACTIONS.items()
) + " ELSE [] END"
_V2_DEICTIC = r"\b(?:" + "|".join(lx.V2_DEICTIC) + r")\b"
V2 = f"""c0 AS (
  SELECT *, {clean_sampling(_MSG)} AS cur, {clean_sampling(_CTX)} AS ctx FROM contextual),
c1 AS (SELECT *, cur || ' ' || ctx AS both_text, {_V2_SCORES} AS s FROM c0),
c2 AS (
  SELECT *, {scores('both_text', lx.V2_ACTIONS)} AS sa,
    list_max(s)::INTEGER AS candidate_score,
    list_reverse_sort(s)[2]::INTEGER AS candidate_second_score,
    {lits(list(lx.V2_INTENTS))}[list_position(s, list_max(s))] AS best_label
  FROM c1),
c3 AS (
  SELECT *, (candidate_score - candidate_second_score)::INTEGER AS candidate_margin,
    {best_label('sa', list(lx.V2_ACTIONS), 'unknown')} AS candidate_action
  FROM c2),
c4 AS (
  SELECT *,
    CASE WHEN candidate_score = 0 THEN 'unknown'
      WHEN candidate_score <= 2 AND candidate_margin <= 1 THEN 'ambiguous'
      ELSE best_label END AS candidate_intent,
    {joined(_V2_MATCHES, '; ')} AS candidate_matches,
    {joined(_V2_ACTION_MATCHES, '; ')} AS candidate_action_matches,
    {_V2_FLAGS} AS flags,
    list_filter([
      CASE WHEN {n_words('cur')} <= 4 THEN 'short_message' END,
      CASE WHEN regexp_matches(cur, {lit(_V2_DEICTIC)}) THEN 'deictic_reference' END,
      CASE WHEN {n_words('cur')} <= 8 AND {n_words('ctx')} > 15 THEN 'context_dependent' END,
      CASE WHEN candidate_score > 0 AND candidate_margin <= 1 THEN 'competing_intents' END
    ], lambda r: r IS NOT NULL) AS reasons
  FROM c3),
v2 AS (
  SELECT *, {joined('flags', ';')} AS escalation_flags, len(flags) > 0 AS escalation_candidate,
    {joined('reasons', ';')} AS ambiguity_reasons,
    (2 * len(reasons))::INTEGER AS ambiguity_score,
    2 * len(reasons) >= 4 AS ambiguity_candidate
  FROM c4),
v2d AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY cur
      ORDER BY customer_created_at, customer_tweet_id, brand_tweet_id) AS copy
    FROM v2 WHERE cur <> '')
  WHERE copy = 1)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
