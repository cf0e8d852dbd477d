"""DuckDB SQL of queries whose rule SQL can state (the others have theirs beside
the operator): each reads the rule plainly, pair by pair or window by window."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every two neighbouring lines that occur before go, but for a pair that overlaps
#: its own first occurrence.
OP2_SQL = r"""WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
pairs AS (SELECT doc_id, l, unnest(range(1, len(l))) AS k FROM docs WHERE len(l) > 1),
told AS (SELECT doc_id, k, l[k] AS one, l[k + 1] AS two FROM pairs),
firsts AS (SELECT one, two, min((doc_id, k)) AS f FROM told GROUP BY one, two HAVING count(*) > 1),
cuts AS (
  SELECT t.doc_id, t.k FROM told t JOIN firsts f USING (one, two)
  WHERE (t.doc_id, t.k) <> f.f AND (t.doc_id, t.k - 1) <> f.f),
gone AS (SELECT doc_id, k AS n FROM cuts UNION SELECT doc_id, k + 1 FROM cuts),
lists AS (SELECT doc_id, list(n) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(l) END::INTEGER AS n_lines, coalesce(len(gone), 0)::INTEGER AS n_removed,
       CASE WHEN gone IS NULL THEN d.text
            ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)) END AS text
FROM docs d LEFT JOIN lists USING (doc_id)"""

#: All documents that share a shingle, compared by the sizes of their sets.
OP4_SQL = rf"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM docs WHERE len(w) > 0),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
said AS (SELECT doc_id, hash(unnest(s)) AS h FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM said a JOIN said b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l USING (doc_id) LEFT JOIN sizes s USING (doc_id)"""

#: The windows of the items, met with the documents' windows of the same length.
OP8_SQL = rf"""WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
parts AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM sized),
asked AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS x FROM parts),
lengths AS (SELECT DISTINCT n FROM asked),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.n, p.k, a.item_id FROM places p JOIN asked a ON a.n = p.n AND a.x = array_to_string(p.w[p.k : p.k + p.n - 1], ' ')),
spans AS (SELECT DISTINCT doc_id, n, k FROM hits),
marked AS (SELECT doc_id, unnest(range(k, k + n)) AS place FROM spans),
counted AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM marked GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM docs d LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)"""
