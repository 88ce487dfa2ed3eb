"""DuckDB statements for the rows of the queries that SQL can express."""

from threadlens.llm import licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{_UPPER}', '{_LOWER}') AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(o.keeper <> k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Sources that reach three times their size are those with the smallest size per weight:
# with sources in that order, the level is set by the first one that stays below it.
MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('17:' || doc_id) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]
           AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS capped,
         sum(weight) OVER after AS rest,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM s
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY source_size / weight, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT (total - capped) / rest AS level FROM r
  WHERE (total - capped) / rest * weight < 3.0 * source_size ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * coalesce(level, 0)) AS target
  FROM s LEFT JOIN level ON true),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS i FROM d WHERE size > 0),
-- One document of every source at a time: it is taken if what is left of the target holds it.
walk(source, i, used, taken) AS (
  SELECT source, 0::BIGINT, 0::BIGINT, false FROM g
  UNION ALL
  SELECT w.source, n.i, CASE WHEN w.used + n.size <= g.target - g.whole * g.source_size
                             THEN w.used + n.size ELSE w.used END,
         w.used + n.size <= g.target - g.whole * g.source_size
  FROM walk w JOIN n ON n.source IS NOT DISTINCT FROM w.source AND n.i = w.i + 1
  JOIN g ON g.source IS NOT DISTINCT FROM w.source)
SELECT d.doc_id, d.size, g.source_size, g.target,
       ((g.whole + CASE WHEN w.taken THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN walk w ON w.source IS NOT DISTINCT FROM n.source AND w.i = n.i
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
      ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS s
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT i.a, i.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) i
  JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b
  WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.node, e.b FROM reach r
  JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON r.other = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id,
       d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

VECTOR_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e)
        / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.98),
reach(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id,
       e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

# Divergences of sources: every group with every kept term and every peer.
SOURCE_DIVERGENCE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words,
         row_number() OVER () AS row
  FROM documents),
w AS (SELECT row, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n
  FROM g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) n
    ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 2))
         // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p
  FROM c),
l AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2))
         // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
    GROUP BY ALL) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT p.lang, p.source, p.term AS item, ((p.p - l.q) * (p.p - l.q) // (p.p + l.q))::BIGINT AS value
  FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""

URL_FILTERS = rf"""
WITH u AS (
  SELECT page_id, url,
         CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path,
         row_number() OVER () AS row
  FROM u),
r(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT h.row, arg_max(struct_pack(rule := rhost || rpath, action := action), length(rhost || rpath)) AS b
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY h.row)
SELECT h.page_id, h.host, h.path, best.b.rule AS rule, coalesce(best.b.action, 'allow') AS verdict
FROM h LEFT JOIN best ON best.row = h.row
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same,
         list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.row <> c.row WHERE a.vec_id % 50 = 0),
pos AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id, n.row)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN s n ON n.anchor = p.anchor AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id, n.row) <= 3
"""


# What SPDX tags name, by hand: expressions, their parts, and the licenses' names.
_SPDX_TAGGED = r"""
tags AS (
  SELECT doc_id, unnest(regexp_extract_all(text,
    '(?i)spdx-license-identifier:[ \t]*((?:\([ \t]*)*[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?(?:[ \t]*\))*(?:[ \t]+(?:and|or|with)[ \t]+(?:\([ \t]*)*[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?(?:[ \t]*\))*)*)',
    1)) AS expression
  FROM documents),
spdx AS (
  SELECT doc_id, trim(unnest(string_split_regex(
    translate(regexp_replace(expression, '(?i)[ \t]+with[ \t]+[^ \t()]+', '', 'g'), '()', '  '),
    '(?i)[ \t]+(?:and|or)[ \t]+')), ' ' || chr(9)) AS id
  FROM tags),
tagged AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS tagged FROM (
    SELECT doc_id, CASE
      WHEN lower(id) IN ('mit', 'isc') THEN upper(id)
      WHEN lower(id) = 'unlicense' THEN 'Unlicense'
      WHEN lower(id) IN ('apache-2.0') THEN 'Apache-2.0'
      WHEN lower(id) IN ('bsd-2-clause', 'bsd-3-clause') THEN 'BSD-' || substr(id, 5, 1) || '-Clause'
      WHEN lower(id) IN ('mpl-2.0', 'cc0-1.0') THEN upper(id)
      WHEN regexp_full_match(id, '(?i)lgpl-(2\.0|2\.1|3\.0)(-only|-or-later|\+)?') THEN 'LGPL'
      WHEN regexp_full_match(id, '(?i)(agpl-3|gpl-2|gpl-3)\.0(-only|-or-later|\+)?')
        THEN upper(regexp_extract(id, '^[^.]*')) || '.0'
      WHEN regexp_full_match(id, '(?i)cc-by(-nc-sa|-nc-nd|-nc|-sa|-nd)?-[0-9.]+')
        THEN upper(regexp_replace(id, '-[0-9.]+$', ''))
      ELSE id END AS name
    FROM spdx WHERE id <> '') GROUP BY doc_id)"""


def license_scan() -> str:
    """The rules one after the other, as nested queries."""
    cases = "\n".join(
        f"WHEN regexp_full_match(s, '{pattern}') THEN '{name}'" for name, pattern in licenses.SENTENCES
    )
    state = "SELECT doc_id, pos, coalesce(ids, '') AS ids, coalesce(run, '') AS run, []::VARCHAR[] AS found FROM runs"
    for name, ids in licenses.RULES:
        text = licenses.rule_pattern(ids)
        state = (
            f"SELECT doc_id, pos, ids, replace(run, '{text}', ',') AS run, "
            f"CASE WHEN contains(run, '{text}') THEN list_append(found, '{name}') ELSE found END AS found "
            f"FROM ({state})"
        )
    return f"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(
           regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                          '{licenses.BREAK}', '\\1' || chr(10), 'g'), chr(10))) AS part
  FROM documents),
numbered AS (SELECT doc_id, row_number() OVER () AS place, part FROM parts),
said AS (
  SELECT doc_id, place, trim(regexp_replace(part, '{licenses.OTHER}', ' ', 'g')) AS s FROM numbered
  WHERE regexp_matches(part, '{licenses.CUES.replace(" ", "[^a-z0-9]+")}')),
known AS (SELECT doc_id, place, CASE {cases} END AS id FROM said),
runs AS (
  SELECT d.doc_id, count(k.id) AS pos, string_agg(k.id, ',' ORDER BY k.place) AS ids,
         string_agg(',' || k.id || ',', '' ORDER BY k.place) AS run
  FROM documents d LEFT JOIN (SELECT * FROM known WHERE id IS NOT NULL) k ON k.doc_id = d.doc_id
  GROUP BY d.doc_id),{_SPDX_TAGGED}
SELECT doc_id, pos AS n_sentences, ids AS sentence_ids,
       array_to_string(list_sort(list_distinct(found)), ',') AS licenses,
       array_to_string(list_filter(string_split(run, ','), lambda x: x <> ''), ',') AS unmatched,
       coalesce(tagged.tagged, '') AS tagged
FROM ({state}) LEFT JOIN tagged USING (doc_id)
"""
