"""SQL for the operators that SQL can express on whole tables. Words are cut by the same classes of bytes as in the operators."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Word 5-grams of every document, joined with each other; links at a similarity of 0.85; the smallest document that each one reaches.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""

#: Every window of item words against every run of as many document words.
LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (
    SELECT DISTINCT item, size, array_to_string(ws[k : k + size - 1], ' ') AS g
    FROM (SELECT item, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)
),
t AS (
    SELECT doc_id, size, k, array_to_string(ws[k : k + size - 1], ' ') AS g
    FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM v) WHERE len(ws) >= size)
),
m AS (SELECT doc_id, item, k, t.size FROM t JOIN v ON t.size = v.size AND t.g = v.g),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)
"""


def _clusters(k: int = 40, rounds: int = 5, dims: int = 64, steps: int = 256, seed: int = 2) -> str:
    """Lloyd's rounds one after the other, every distance from its components; exact in integers."""
    assign = (
        "a{r} AS MATERIALIZED (SELECT id, x, m.c AS c, m.d AS d FROM (SELECT id, any_value(x) AS x, min(struct_pack(d := d, c := c)) AS m FROM ("
        "SELECT v.id, v.x, o.c, list_sum(list_transform(list_zip(v.x, o.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r} o) GROUP BY id))"
    )
    move = (
        "u{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{p}, range(1, {dims} + 1) t(i) GROUP BY c, i) GROUP BY c),\n"
        "c{r} AS MATERIALIZED (SELECT o.c, coalesce(u.x, o.x) AS x FROM c{p} o LEFT JOIN u{r} u USING (c))"
    )
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor({steps} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, x FROM (SELECT x, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
        assign.format(r=0),
    ]
    for r in range(1, rounds + 1):
        parts += [move.format(r=r, p=r - 1, dims=dims), assign.format(r=r)]
    last = f"a{rounds}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT v.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(o.x, ',')) AS centroid_sha256\nFROM {last} a JOIN v USING (id) JOIN c{rounds} o ON o.c = a.c"
    )


CLUSTERS = _clusters()
