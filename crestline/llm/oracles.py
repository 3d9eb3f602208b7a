"""DuckDB SQL for the operators that SQL can express; it compares all rows with all rows."""

from __future__ import annotations

#: The smallest id that links (a, b), given both ways, reach from each id of nodes. On the way from it every id is larger.
_COMPONENTS = """
reach AS (
    SELECT id AS node, id AS least FROM nodes
    UNION
    SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node WHERE l.b > r.least
),
components AS (SELECT node AS id, min(least) AS component_id FROM reach GROUP BY node)
"""

OP3_EMBEDDINGS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
whole AS (
    SELECT id, v FROM nodes
    WHERE len(v) > 0 AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0
),
links AS (
    SELECT p.id AS a, q.id AS b FROM whole p JOIN whole q ON p.id <> q.id AND len(p.v) = len(q.v)
    WHERE list_cosine_similarity(p.v, q.v) >= 0.95
),
{_COMPONENTS},
degrees AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM components LEFT JOIN degrees USING (id)
"""

OP4_MINHASH = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                    ELSE list_distinct([concat_ws(' ', z[1], z[2], z[3]) FOR z IN list_zip(w[: len(w) - 2], w[2 : len(w) - 1], w[3 :])]) END AS s
    FROM words
),
nodes AS (SELECT id FROM sets),
-- Documents with one set are compared once.
classes AS (SELECT list_sort(s) AS s, min(id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
coded AS (SELECT rep, n, hash(x) AS x FROM (SELECT rep, n, unnest(s) AS x FROM classes)),
-- Sets that are 85 hundredths alike share a shingle among the rarest of each, as many as may be missing and one more.
ranked AS (SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY f, x) AS place FROM coded JOIN (SELECT x, count(*) AS f FROM coded GROUP BY x) USING (x)),
rare AS (SELECT * FROM ranked WHERE place <= n - ceil(0.85 * n) + 1),
candidates AS (SELECT DISTINCT p.rep AS a, q.rep AS b, p.n AS m, q.n AS n FROM rare p JOIN rare q ON p.x = q.x AND p.rep < q.rep WHERE 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)),
found AS (
    SELECT c.a, c.b FROM candidates c JOIN coded p ON p.rep = c.a JOIN coded q ON q.rep = c.b AND q.x = p.x
    GROUP BY c.a, c.b, c.m, c.n HAVING 100 * count(*) >= 85 * (c.m + c.n - count(*))
),
copies AS (SELECT id, rep FROM sets JOIN classes ON list_sort(sets.s) = classes.s WHERE id <> rep),
links AS (
    SELECT a, b FROM found UNION SELECT b, a FROM found
    UNION SELECT id, rep FROM copies UNION SELECT rep, id FROM copies
),
{_COMPONENTS}
SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM components JOIN sets USING (id)
"""

OP6_TOPK = """
WITH whole AS (
    SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP7_WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
facts AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM payloads),
-- Five hexadecimal digits are four of base 32.
parts AS (SELECT page_id, [('0x' || hex[5 * i + 1 : 5 * i + 5])::BIGINT FOR i IN range(0, 8)] AS twenty FROM facts)
SELECT page_id, payload_bytes,
       array_to_string(flatten([['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((t >> s) & 31) + 1] FOR s IN [15, 10, 5, 0]] FOR t IN twenty]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM facts JOIN parts USING (page_id)
"""

OP11_FILTER_AUDIT = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS later FROM texts),
docs AS (
    SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
           [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), later] AS fails
    FROM words LEFT JOIN labels USING (doc_id)
),
f AS (SELECT unnest(range(1, 6)) AS k),
orders AS (
    SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
),
-- The step of an order that removes the document, 6 if none does.
gone AS (SELECT ks, docs.*, coalesce(list_position([fails[k] FOR k IN ks], true), 6) AS nth FROM docs, orders),
counted AS (
    SELECT part, ks, step, ks[step] AS k,
           count(*) FILTER (WHERE nth > step) AS kept, count(*) FILTER (WHERE nth = step) AS removed, count(*) FILTER (WHERE nth < step AND fails[ks[step]]) AS redundant,
           count(*) FILTER (WHERE fails[ks[step]] AND len([x FOR x IN fails IF x]) = 1) AS unique_fails,
           count(*) FILTER (WHERE nth = step AND good) AS good_lost, count(*) FILTER (WHERE nth = step AND toxic) AS toxic_lost
    FROM gone, (SELECT k AS step FROM f) GROUP BY part, ks, step
)
SELECT part, array_to_string([['A', 'B', 'C', 'D', 'E'][i] FOR i IN ks], '') AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, trained models and page markup can't be expressed in SQL; these five can."""
    return {"op3_embeddings": OP3_EMBEDDINGS, "op4_minhash": OP4_MINHASH, "op6_topk": OP6_TOPK, "op7_warc": OP7_WARC, "op11_filter_audit": OP11_FILTER_AUDIT}
