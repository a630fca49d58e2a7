"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from .queries import LIST_ENTRIES
from .url_filter import HOST

#: Rows of ``documents`` with the ASCII white space of the contracts as a class.
_SPACE = r"[\x20\x09-\x0D]"

OP4 = rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

OP6 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 12)) AS u(p) WHERE len(w) >= 13),
f AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, q FROM (SELECT win.doc_id, win.p FROM win JOIN f ON win.g = f.g WHERE f.first_id < win.doc_id) x, unnest(generate_series(p, p + 12)) AS u(q)),
t AS (SELECT doc_id, word, q FROM d, unnest(w) WITH ORDINALITY AS u(word, q)),
k AS (SELECT t.doc_id, count(hit.q) AS n_removed, string_agg(CASE WHEN hit.q IS NULL THEN t.word END, ' ' ORDER BY t.q) AS kept
      FROM t LEFT JOIN hit ON t.doc_id = hit.doc_id AND t.q = hit.q GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS g
       FROM b, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS u(p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, p, lens.n AS n, array_to_string(w[p : p + lens.n - 1], ' ') AS g
       FROM d, lens, unnest(generate_series(1, len(w) - lens.n + 1)) AS u(p) WHERE len(w) >= lens.n),
h AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hw AS (SELECT DISTINCT doc_id, q FROM (SELECT DISTINCT doc_id, p, n FROM h) x, unnest(generate_series(p, p + n - 1)) AS u(q)),
hc AS (SELECT doc_id, count(*) AS n_hit FROM hw GROUP BY doc_id),
ic AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hc ON d.doc_id = hc.doc_id LEFT JOIN ic ON d.doc_id = ic.doc_id
"""

OP3 = r"""
WITH l AS (
  SELECT doc_id, p, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       unnest(ls) WITH ORDINALITY AS u(line, p)),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY p), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""

_LISTED = ", ".join(f"('{p}', '{a}', date '{d}')" for p, a, d in LIST_ENTRIES)
OP9 = rf"""
WITH list AS (SELECT * FROM (VALUES {_LISTED}) AS t(pattern, action, listed_at)),
spans AS (SELECT pattern, action, listed_at AS since, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS until FROM list),
p AS (SELECT page_id, url, CAST(date '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS at,
             rtrim(regexp_extract(lower(url), '{HOST}', 1), '.') AS host,
             regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.page_id, s.pattern, s.action, row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.pattern) DESC) AS rn
      FROM p JOIN spans s ON s.action <> 'remove' AND s.since <= p.at AND (s.until IS NULL OR p.at < s.until)
       AND (host = s.pattern OR ends_with(host, '.' || s.pattern) OR host || path = s.pattern OR starts_with(host || path, s.pattern || '/')))
SELECT p.page_id, p.url, CAST(p.at AS VARCHAR) AS fetched_at, m.pattern, m.action, coalesce(m.action, '') <> 'block' AS kept
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.rn = 1
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS u(p) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) x
      JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.m)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(x.m, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) x ON x.doc_id = d.doc_id
"""

OP11 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)),
m AS (SELECT *, len(regexp_extract_all(role || chr(0) || text, '<\\*(s>|/s>|\|endoftext\|>)|\[\\*/?INST\]')) AS escapes FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(17 + length(role) + length(text) + escapes) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

OP12 = r"""
WITH own AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x : ascii(x)::BIGINT)),
                 lambda s, b : list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda m, z : CASE WHEN m % 2 = 1 THEN xor(m >> 1, 3988292384) ELSE m >> 1 END)), 4294967295) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM own) x),
size AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
rebuilt AS (SELECT c.conv_id, o.pos, role, text FROM c JOIN own o ON o.conv_id = c.base AND o.pos <= h
            UNION ALL SELECT c.conv_id, least(h, coalesce(s.n, 0)) + o.pos - h, role, text
            FROM c JOIN own o ON o.conv_id = c.conv_id AND o.pos > h LEFT JOIN size s ON s.conv_id = c.base),
seq AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY pos) AS s, list(strlen(text) ORDER BY pos) AS b FROM rebuilt GROUP BY conv_id),
m AS (SELECT c.conv_id, d, coalesce(array_to_string(s[1:d], ''), '') AS k, CASE WHEN d = 0 THEN 0 ELSE b[d] END AS bytes, d = coalesce(len(s), 0) AS ended
      FROM c LEFT JOIN seq ON seq.conv_id = c.conv_id, unnest(generate_series(0, coalesce(len(s), 0))) AS u(d)),
node AS MATERIALIZED (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, min(bytes) AS bytes,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends FROM m GROUP BY d, k),
kids AS (SELECT left(k, CAST(64 * (d - 1) AS BIGINT)) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
below AS (SELECT left(node.k, CAST(64 * u.d AS BIGINT)) AS k, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((node.n - 1) * node.bytes) AS saved
          FROM node LEFT JOIN kids ON kids.k = node.k, unnest(generate_series(0, node.d)) AS u(d) GROUP BY 1)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node LEFT JOIN node up ON up.d = node.d - 1 AND up.k = left(node.k, CAST(64 * (node.d - 1) AS BIGINT))
LEFT JOIN kids ON kids.k = node.k JOIN below ON below.k = node.k
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM d, unnest(w) AS u(term) GROUP BY r, lang, source, term),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= 3),
c AS MATERIALIZED (SELECT t.lang, t.source, t.term, sum(t.n) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
gp AS MATERIALIZED (SELECT g.lang, g.source, k.term, c.n AS held,
              1 + CAST(1000000000 * (coalesce(c.n, 0) + 1) AS HUGEINT) // CAST(coalesce(gn.n, 0) + l.v AS HUGEINT) AS p,
              1 + CAST(1000000000 * (k.n + 1) AS HUGEINT) // CAST(l.n + l.v AS HUGEINT) AS q
       FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
       LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
       FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(pv.value, 0) AS value
          FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN pv ON pv.lang = g.lang AND pv.source = g.source AND pv.item = o.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM gp WHERE held > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {"op3_line_dedup": OP3, "op4_exact_dedup": OP4, "op6_substring_dedup": OP6, "op7_decontamination": OP7, "op9_url_filter": OP9, "op10_jaccard_join": OP10, "op11_chat_formatting": OP11, "op12_conversation_trie": OP12, "op13_source_divergence": OP13}
