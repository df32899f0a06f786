"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
l AS (SELECT d, max(page_id) AS leader FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> leader THEN leader END AS refers_to
FROM q LEFT JOIN l USING (d)
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE g IN (SELECT g FROM rep)) GROUP BY doc_id),
kept AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY i) AS t
  FROM (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) u
  LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) r ON u.doc_id = r.doc_id AND u.i = r.p
  WHERE r.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x),
k AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
  coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_OP7 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
d AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
again AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT g.doc_id, unnest(range(i, i + 3)) AS p FROM g JOIN again ON g.doc_id = again.doc_id AND g.g = again.g)
  GROUP BY 1),
l AS (
  SELECT doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS i
        FROM t)),
f AS (
  SELECT *, len(w) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[A-Z]')) AS upper,
    len(regexp_extract_all(line, '[a-z]')) AS lower,
    len(list_filter(w, lambda v: v IN ('|', '>', '<', '/', '-', '»', '·', '•', '›'))) AS separators,
    len(list_filter(w, lambda v: ends_with(v, '!!'))) AS loud,
    len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS stutter
  FROM l WHERE len(w) > 0),
j AS (
  SELECT doc_id, n, dup, dup
    OR (symbols >= 3 AND 2 * symbols > n)
    OR (separators >= 3 AND 5 * separators >= n)
    OR (upper >= 20 AND upper > lower)
    OR (loud >= 3 AND 5 * loud >= n)
    OR (stutter >= 3 AND 10 * stutter >= 3 * n)
    OR (n <= 20 AND regexp_matches(line, '(?i)^\W*(licensed under|copyright|all rights reserved|cookie policy'
      || '|privacy policy|terms of (use|service)|javascript|subscribe|sign (in|up)|log ?in|read more|click here'
      || '|share this|follow us)\b'))
    OR (n >= 30 AND NOT regexp_matches(line, '[.,;:!?]')) AS bad
  FROM f),
q AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup, sum(n) FILTER (NOT bad) AS n_left FROM j GROUP BY 1),
b AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_left, 0) AS BIGINT) AS n_words_left
  FROM d LEFT JOIN q USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_left >= 50 * n_words AS kept
FROM b
"""

_OP11 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 10
"""

_OP12 = r"""
WITH c AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(concat(length(r), ':', r, x))) AS i FROM c),
t AS (SELECT c, list({'r': r, 'x': x} ORDER BY i) AS l FROM o GROUP BY c),
e AS (
  SELECT c, l, list_transform(range(0, 8 * length(CAST(c AS VARCHAR))), lambda j:
    CASE WHEN j % 8 = 0 THEN CAST(ascii(substr(CAST(c AS VARCHAR), j // 8 + 1, 1)) AS BIGINT) ELSE 0 END) AS bytes FROM t),
h AS (
  SELECT c, l, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, b:
    xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) % 4 AS h FROM e),
b AS (SELECT h.c, list_concat(coalesce(t.l, [])[1:h], h.l[h + 1:]) AS l FROM h LEFT JOIN t ON t.c = h.c - h.c % 20),
p AS (SELECT c, d, l[1:d] AS k, d = len(l) AS whole FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM b)),
n AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (whole), '')) AS ends_sha256
  FROM p GROUP BY k, d),
m AS (SELECT n.*, q.conv_id AS parent FROM n LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.k[1:n.d - 1] AND n.d > 0),
s AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1, 2),
w AS (
  SELECT m.*, coalesce(s.n_children, 0) AS n_children,
    CASE WHEN m.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(m.k[m.d].x, '[^\x20\x09-\x0D]+')) END AS saved
  FROM m LEFT JOIN s ON s.parent = m.conv_id AND s.d = m.d),
a AS (
  SELECT k[1:g] AS k, g AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT w.*, unnest(range(0, d + 1)) AS g FROM w) GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, w.parent AS parent_conv_id, n_convs, CAST(w.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM w JOIN a ON a.d = w.d AND a.k = w.k
"""

ORACLES: dict[str, str] = {
    "op1_decontaminate": _OP1,
    "op2_warc_zip": _OP2,
    "op4_substring": _OP4,
    "op5_near_dedup": _OP5,
    "op7_line_rules": _OP7,
    "op11_top_products": _OP11,
    "op12_conversation_trie": _OP12,
}
