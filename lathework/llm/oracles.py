"""DuckDB SQL of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle are counted; components by the transitive closure of the links.
OP3 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
f AS (SELECT item_id, k AS st, least(len(w), 13) AS n, list_slice(w, k, k + 12) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
v AS (SELECT DISTINCT item_id, n, array_to_string(g, ' ') AS g FROM f),
z AS (SELECT DISTINCT n FROM v),
p AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, z WHERE len(w) >= n)),
o AS (SELECT p.doc_id, p.k, p.n, v.item_id FROM p JOIN v ON v.n = p.n AND v.g = p.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY 1),
x AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS q FROM d WHERE len(w) > 0),
c AS (SELECT term, count(*) AS n FROM x GROUP BY 1),
g AS (SELECT item_id, st, f.n, k, term, c.n AS often FROM (SELECT item_id, st, n, unnest(g) AS term, unnest(range(1, len(g) + 1)) AS k FROM f) f JOIN c USING (term)),
a AS (SELECT item_id, st, n, arg_min(k, (often, k)) AS ak, arg_min(term, (often, k)) AS term FROM g GROUP BY 1, 2, 3 HAVING count(*) = n),
y AS (SELECT item_id, st, n, ak, doc_id, q FROM a JOIN x USING (term)),
m AS (SELECT y.item_id, y.doc_id, y.st, y.q FROM y JOIN g ON g.item_id = y.item_id AND g.st = y.st JOIN x ON x.doc_id = y.doc_id AND x.term = g.term
AND x.q BETWEEN y.q + g.k - y.ak - 3 AND y.q + g.k - y.ak + 3 GROUP BY y.item_id, y.doc_id, y.st, y.q, y.n HAVING count(DISTINCT g.k) = y.n),
r AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every document that shares a term with an item is scored.
OP12 = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents), i AS (SELECT item_id, row_number() OVER () AS i, {_TERMS} AS w FROM benchmark),
k AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
s AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
c AS (SELECT i, item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * nn) // ll))))) AS BIGINT) AS score FROM k JOIN f USING (term) JOIN t USING (term), s GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= 20"""
