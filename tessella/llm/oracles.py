"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

# Escaped as tessella.llm.chat does: backslashes doubled, one between the characters of "<|".
_CHAT = r"""
WITH rows AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
turns AS (
    SELECT conv_id, role, coalesce(role, '') AS r, coalesce(text, '') AS t,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
    FROM rows
),
sized AS (
    SELECT *, length(replace(replace(replace(r, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)))
            + length(replace(replace(t, '\', '\\'), '<|', '<\|')) + 24 AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

# Chunks as tessella.llm.line_chunks makes them: long lines alone, short ones by a rolling hash.
_LINES = r"""
WITH pieces AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM pieces),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines),
hashed AS (SELECT *, CASE WHEN words < 8 THEN CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) END AS h FROM counted),
beside AS (
    SELECT *, lag(h) OVER w AS h1, lag(h, 2) OVER w AS h2 FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
begun AS (
    SELECT *, sum(CASE WHEN i = 0 OR h IS NULL OR h1 IS NULL OR (coalesce(h2, 0) * 31 + h1) % 4 = 0 THEN 1 ELSE 0 END)
              OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos
    FROM beside
),
chunks AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, sum(words) AS words FROM begun GROUP BY doc_id, pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) AS copy FROM chunks),
later AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM ranked WHERE copy > 1),
gone AS (SELECT doc_id, pos FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS total FROM later) WHERE total >= 20),
cut AS (
    SELECT c.doc_id, count(g.pos) AS n_removed,
           coalesce(string_agg(c.chunk, chr(10) ORDER BY c.pos) FILTER (WHERE g.pos IS NULL), '') AS text
    FROM chunks c LEFT JOIN gone g USING (doc_id, pos) GROUP BY c.doc_id
)
SELECT d.doc_id, c.text, coalesce(c.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN cut c USING (doc_id)
"""

_SEARCH = r"""
WITH low AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
),
docs AS (SELECT row_number() OVER () AS doc, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM low WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
words AS (SELECT doc, doc_id, n, unnest(terms) AS term FROM docs),
counted AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
held AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM held, totals),
parts AS (
    SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS part
    FROM counted JOIN weights USING (term), totals
),
scored AS (
    SELECT item_id, doc, any_value(doc_id) AS doc_id, CAST(sum(part) AS BIGINT) AS score
    FROM asked JOIN parts USING (term) GROUP BY item_id, doc
),
ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

_AUDIT = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts
),
judged AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels GROUP BY doc_id
),
flags AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, {
        'A': len(words) < 200,
        'B': 100 * list_unique(words) < 50 * len(words),
        'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
        'D': regexp_matches(t, '[#$%&*|]'),
        'E': coalesce(worded.doc_id > first_id, false)} AS f
    FROM worded LEFT JOIN judged ON worded.doc_id = judged.doc_id
),
fails AS (
    SELECT part, good, bad, CASE WHEN f.A THEN 'A' ELSE '' END || CASE WHEN f.B THEN 'B' ELSE '' END || CASE WHEN f.C THEN 'C' ELSE '' END
           || CASE WHEN f.D THEN 'D' ELSE '' END || CASE WHEN f.E THEN 'E' ELSE '' END AS failed
    FROM flags
),
sets AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM fails GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
lists AS (
    SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
    WHERE list_unique([a.c, b.c, d.c, e.c, f.c]) = 5
),
steps AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS mine,
           substr(filter_order, 1, CAST(step AS INTEGER) - 1) AS earlier
    FROM lists, range(1, 6) r(step)
),
placed AS (
    SELECT part, filter_order, step, mine, n, good, bad, failed, contains(failed, mine) AS fails_mine,
           len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 AND failed != '' AND earlier != '' AS gone
    FROM sets, steps
),
summed AS (
    SELECT part, filter_order, step, mine,
           CAST(sum(CASE WHEN NOT fails_mine AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
           CAST(sum(CASE WHEN fails_mine AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
           CAST(sum(CASE WHEN fails_mine AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
           CAST(sum(CASE WHEN failed = mine THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
           CAST(sum(CASE WHEN fails_mine AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
           CAST(sum(CASE WHEN fails_mine AND NOT gone THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM placed GROUP BY part, filter_order, step, mine
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
FROM summed
"""

SQL = {"op1_line_chunks": _LINES, "op4_reply_trees": _CHAT, "op11_term_scan": _SEARCH, "op13_filter_audit": _AUDIT}
