"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words between what is no part of one.
_WORDS = "list_filter(string_split_regex({0}, '{1}'), lambda x: x <> '')"
_SPACE, _OTHER = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP5 = f"""WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_LOWER, _OTHER)} AS ws FROM benchmark),
ip AS (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM it WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS win FROM ip),
d AS (SELECT doc_id, {_WORDS.format(_LOWER, _OTHER)} AS ws FROM documents),
p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n),
h AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win FROM p) JOIN iw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM h, range(10) t(o) WHERE o < n GROUP BY 1),
f AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)"""

OP7 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')", _SPACE)} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
s AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 34], ' ')) AS h FROM p),
r AS (SELECT h FROM s GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i FROM s SEMI JOIN r USING (h)), range(35) t(o)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER, _SPACE)} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 90 * (x.n + y.n - i)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
q AS (SELECT u AS doc_id, u AS r FROM b UNION SELECT q.doc_id, b.v FROM q JOIN b ON q.r = b.u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(d.doc_id, m), d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS m FROM q GROUP BY 1) t USING (doc_id)"""

_CRC_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda a: CAST(ascii(a) AS BIGINT))), lambda c, b: {_CRC_STEP}), 4294967295)"
_FIELD = "coalesce(concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)), '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + "))"
#: Levels of a tree over leaf rows (g, i, n, h): each is folded from the one below.
_TREE = "SELECT g, 0 AS l, i, n, h FROM {leaves} UNION ALL SELECT g, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {tree} WHERE n > 1 GROUP BY g, l, i // 3, n"

OP11 = f"""WITH RECURSIVE d AS (SELECT doc_id, source AS g, {_LEAF.format("text")} AS h, CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS now FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
tree AS ({_TREE.format(leaves="leaves", tree="tree")}),
subroots AS (SELECT g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top_leaves AS (SELECT 0 AS g, i, n, h FROM subroots),
top AS ({_TREE.format(leaves="top_leaves", tree="top")}),
sides AS (SELECT a.g, a.l, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi FROM tree a JOIN tree b ON a.g IS NOT DISTINCT FROM b.g AND a.l = b.l AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
top_sides AS (SELECT a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi FROM top a JOIN top b ON a.l = b.l AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
walk AS (SELECT doc_id, g, i AS leaf_i, 0 AS l, i, '' AS seen, now AS f FROM leaves UNION ALL
 SELECT w.doc_id, w.g, leaf_i, w.l + 1, w.i // 3, concat(seen, lo, hi), sha256(concat(lo, f, hi)) FROM walk w JOIN sides s ON w.g IS NOT DISTINCT FROM s.g AND w.l = s.l AND w.i = s.i),
below AS (SELECT w.*, s.i AS top_i, s.h AS subroot FROM walk w JOIN tree t ON t.n = 1 AND t.g IS NOT DISTINCT FROM w.g AND t.l = w.l JOIN subroots s ON s.source IS NOT DISTINCT FROM w.g),
climb AS (SELECT doc_id, g, leaf_i, subroot, 0 AS l, top_i AS i, seen, f FROM below UNION ALL
 SELECT c.doc_id, c.g, leaf_i, subroot, c.l + 1, c.i // 3, concat(seen, lo, hi), sha256(concat(lo, f, hi)) FROM climb c JOIN top_sides s ON c.l = s.l AND c.i = s.i)
SELECT c.doc_id, v.h AS leaf, subroot, t.h AS root, sha256(seen) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM climb c JOIN top t ON t.n = 1 AND t.l = c.l JOIN leaves v ON v.g IS NOT DISTINCT FROM c.g AND v.i = c.leaf_i"""

_P = "(1 + 1000000000::HUGEINT * ({0} + 1) // greatest({1} + v, 1))"
_F = "(({0} - {1}) * ({0} - {1}) // {1})"
OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS HUGEINT) AS lang_total FROM k GROUP BY 1),
g AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, k.term, coalesce(n, 0) AS n, {_P.format("coalesce(n, 0)", "total")} AS p, {_P.format("lang_n", "lang_total")} AS lang_p FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum({_F.format("a.p", "b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST({_F.format("p", "lang_p")} AS BIGINT) FROM p WHERE n > 0 AND p > lang_p),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C") AS INT) AS rank FROM x)
SELECT * FROM y WHERE part = 'pair' OR rank <= 200"""
