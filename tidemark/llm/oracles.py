"""SQL (DuckDB) for the operators that SQL can express; the others are tested against brute force."""

OP8 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
m AS (SELECT x, min(doc_id) AS m FROM w GROUP BY x),
c AS (SELECT w.doc_id, w.i FROM w JOIN m ON m.x = w.x WHERE m.m < w.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM c),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
p AS (SELECT s.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT p.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, sym.b FROM reach r JOIN sym ON sym.a = r.b)
SELECT n.doc_id, n AS n_shingles, least(n.doc_id, coalesce(min(b), n.doc_id)) AS component_id FROM n LEFT JOIN reach ON a = n.doc_id GROUP BY n.doc_id, n
"""

OP12 = r"""
WITH RECURSIVE bits AS (SELECT b, b::BIGINT AS v, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS tab FROM bits WHERE k = 8),
t AS (SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(s ORDER BY i) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda a, z: xor(tab[(xor(a, z) & 255) + 1], a >> 8))) % 9 AS h FROM c, tab),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h], h.own[h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, s, d, s[1:d] AS pre FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n, any_value(strlen(s[d].x)) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = len(s)), '') AS ends FROM p GROUP BY pre, d),
k AS (SELECT pre[1:d - 1] AS up, count(*) AS children FROM n WHERE d > 0 GROUP BY up),
g AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k ON k.up = n.pre),
a AS (SELECT pre[1:j] AS pre, sum((n - 1) * coalesce(size, 0))::BIGINT AS saved, count(*) FILTER (WHERE children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM g) GROUP BY ALL)
SELECT g.conv_id, g.d::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n AS n_convs, g.children AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN a ON a.pre = g.pre LEFT JOIN g u ON g.d > 0 AND u.d = g.d - 1 AND u.pre = g.pre[1:g.d - 1]
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, '<P>' || substring(t, 1, a) AS pre, '<M>' || substring(t, a + 1, b - a) AS mid, '<S>' || substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
