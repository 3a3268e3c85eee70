"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

RULES_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
),
windows AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
    FROM texts, unnest(range(1, len(words) - 1)) AS r(i)
),
twice AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS s(k) GROUP BY doc_id
),
measured AS (
    SELECT t.doc_id, text, words, lines, len(words) AS n_words,
           coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(c.n, 0) AS n_repeat_words
    FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND word_chars / greatest(n_words, 1) BETWEEN 3 AND 10
       AND n_symbols / greatest(n_words, 1) <= 0.1
       AND n_dup_lines / greatest(len(lines), 1) <= 0.34
       AND n_repeat_words / greatest(n_words, 1) <= 0.3
       AND length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))
           / greatest(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 1) <= 0.4
       AND length(regexp_replace(text, '[^!]', '', 'g')) / greatest(n_words, 1) <= 0.2
       AND len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) / greatest(n_words, 1) >= 0.7
       AND len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;…]['')"»\]]*[\x20\x09-\x0D]*\z')))
           / greatest(len(lines), 1) >= 0.12 AS kept
FROM measured
"""

LINES_SQL = r"""
WITH lines AS (
    SELECT doc_id, i, l[i] AS line, regexp_matches(l[i], '[^\x20\x09-\x0D]') AS worded
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
         unnest(range(1, len(l) + 1)) AS r(i)
),
pairs AS (
    SELECT doc_id, i, line, worded,
           lead(line) OVER w AS next_line, coalesce(lead(worded) OVER w, false) AS next_worded
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
runs AS (
    SELECT doc_id, i,
           row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, i) > 1 AS later
    FROM pairs WHERE worded AND next_worded
),
gone AS (
    SELECT DISTINCT doc_id, i + k AS i FROM runs, unnest([0, 1]) AS s(k) WHERE later
)
SELECT l.doc_id, count(*) FILTER (WHERE worded)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i
GROUP BY l.doc_id
"""

SUBSTRINGS_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
    SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS w
    FROM texts, unnest(range(1, len(words) - 48)) AS r(i)
),
later AS (
    SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY w) < doc_id
),
cut AS (
    SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(range(0, 50)) AS s(k)
),
gone AS (
    SELECT doc_id, list(i) AS places FROM cut GROUP BY doc_id
),
kept AS (
    SELECT t.doc_id, len(words) AS n, coalesce(len(places), 0) AS m,
           CASE WHEN places IS NULL THEN words
                ELSE [words[j] FOR j IN range(1, len(words) + 1) IF NOT list_contains(places, j)] END AS rest
    FROM texts t LEFT JOIN gone g ON t.doc_id = g.doc_id
)
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256
FROM kept
"""

NEAR_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
sets AS (
    SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 3], ' ')) AS s
    FROM texts, unnest(range(1, greatest(len(words) - 3, least(len(words), 1)) + 1)) AS r(i)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 80 * (x.n + y.n - c)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, seen) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.seen
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(seen) AS component_id,
       min(seen) = d.doc_id AS kept
FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       coalesce(doc_id = max(doc_id) OVER same, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
