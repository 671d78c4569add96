"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from vergence.llm import chat, divergence

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = rf"""
WITH every AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v (t, r)),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM every),
marked AS (
    SELECT *, regexp_replace(regexp_replace(role || chr(0) || text, '(<)(\\*(/?s>|\|(image|audio|document|other)\|>))', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g') AS escaped FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = '{chat.LEARNED}'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{chat.LEARNED}'), '')) AS loss_sha256,
    sum(length(escaped) - 1 + {len(chat.BEGIN + chat.MIDDLE + chat.END)})::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""

OP13 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{divergence.TERM}') AS words FROM documents),
t AS (SELECT doc, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT doc, lang, term FROM t) GROUP BY ALL HAVING count(*) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
    SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
    FROM totals JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q
    FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""
