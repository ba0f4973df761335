"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code.

The others have none: token ids (3), discovered spans (4, 10), checksums (6), approximate search (7) and a fitted model (2)
are held against brute force in the tests.
"""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

_OP1 = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
sh AS MATERIALIZED (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
n AS MATERIALIZED (SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN sh ON sh.doc_id = d.doc_id GROUP BY d.doc_id),
links AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT y, root FROM reach JOIN links ON doc_id = x)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""

_OP5 = """
SELECT page_id, url, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM (SELECT *, strlen(h) >= 1000 AND page_id <> last AS again FROM (
    SELECT page_id, url, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages))
"""

_OP8 = rf"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size,
        (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u FROM documents),
e AS MATERIALIZED (SELECT *, length(bin(size)) + 3 AS class FROM d),
s AS (SELECT source, sum(size)::BIGINT AS total, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM e GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * total / w, source NULLS LAST) AS pos FROM s),
l AS (SELECT a.pos, (1.5 * (SELECT sum(total) FROM s) - coalesce((SELECT sum(2 * total) FROM o b WHERE b.pos < a.pos), 0)) / (SELECT sum(w) FROM o b WHERE b.pos >= a.pos) AS level, a.w, a.total FROM o a),
c AS (SELECT level, pos FROM l WHERE level * w <= 2 * total ORDER BY pos LIMIT 1),
t AS (SELECT o.source, o.total, CASE WHEN (SELECT count(*) FROM c) = 0 OR o.pos < (SELECT pos FROM c) THEN (2 * o.total)::DOUBLE ELSE (o.w * (SELECT level FROM c))::DOUBLE END AS target FROM o),
k AS (SELECT source, class, sum(size)::BIGINT AS words FROM e GROUP BY source, class),
kt AS (SELECT k.*, t.target, t.total FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
lv AS (
    SELECT *, (target - 2 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
        / greatest(sum(class * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)::BIGINT AS level FROM kt),
cm AS (SELECT *, max(CASE WHEN level * class <= 2 THEN class END) OVER (PARTITION BY source) AS top FROM lv),
x AS (SELECT *, CASE WHEN class <= top THEN max(CASE WHEN class = top THEN level END) OVER (PARTITION BY source) * class ELSE 2.0::DOUBLE END AS expected FROM cm),
y AS (SELECT *, floor(expected)::INT AS whole, expected - floor(expected) AS p FROM x),
z AS (SELECT *, target - sum(whole * words) OVER (PARTITION BY source)::BIGINT AS rest FROM y),
q AS (
    SELECT e.doc_id, e.source, e.size, e.t, z.total, z.target, z.whole, z.rest, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q
    FROM e JOIN z ON e.source IS NOT DISTINCT FROM z.source AND e.class = z.class),
r AS (SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size, t ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM q)
SELECT doc_id, source, size, total AS source_size, target, copies, copies * size AS taken FROM (
    SELECT *, whole + CASE WHEN q IS NOT NULL AND (upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END AS copies FROM r)
"""

_OP9 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(t, {_WORD}) AS w FROM d),
g AS (SELECT r, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM (SELECT r, list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) AS g FROM w WHERE len(w) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(8) AS x(k) GROUP BY r),
x AS MATERIALIZED (
    SELECT r, doc_id, t, source, x, trim(regexp_replace(translate(lower(x), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(x, {_WORD})) AS n
    FROM (SELECT *, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, {_WORD})),
hosts AS (SELECT source, count(DISTINCT (doc_id, t)) AS docs FROM d GROUP BY source),
common AS (
    SELECT c.source, line FROM (SELECT source, line, count(DISTINCT (doc_id, t)) AS n FROM x GROUP BY source, line) c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
    WHERE n >= 20 AND n >= 0.02::DOUBLE * docs),
lost AS (SELECT r, sum(n) AS n FROM x JOIN common c ON x.line = c.line AND x.source IS NOT DISTINCT FROM c.source GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM x GROUP BY r),
o AS (
    SELECT d.doc_id, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda a: length(a))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
        coalesce(lost.n, 0)::BIGINT AS n_boiler_words
    FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_boiler_words >= 0.3::DOUBLE * n_words AS kept
FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": _OP1, "op5_warc": _OP5, "op8_mixing": _OP8, "op9_quality_rules": _OP9}
