"""DuckDB SQL for the rows of those registered queries that SQL can express."""

from __future__ import annotations

from .lists import BLOCKED_HOSTS, URL_RULES

WHOLE = """
    SELECT vec_id, {label} list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

ORACLES: dict[str, str] = {}

RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
HOSTS = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)

ORACLES["op3_url_filters"] = f"""
WITH rules(verdict, host, path) AS (VALUES {RULES}),
blocked(host) AS (VALUES {HOSTS}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM cut),
fits AS (SELECT n, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), [length(r.host || r.path), length(r.host), (r.verdict = 'block')::INT]) AS best
         FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN EXISTS (SELECT 1 FROM blocked b WHERE p.host = b.host OR ends_with(p.host, '.' || b.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits USING (n)
"""

TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLES["op11_lexical_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {TERMS} AS terms FROM documents),
held AS (SELECT d, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM held),
counts AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM held) x GROUP BY d, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM counts, totals GROUP BY term),
wanted AS (SELECT i, item_id, term, count(*) AS times
           FROM (SELECT i, item_id, unnest(terms) AS term
                 FROM (SELECT row_number() OVER () AS i, item_id, {TERMS} AS terms FROM benchmark) y) x GROUP BY i, item_id, term),
scored AS (SELECT i, item_id, h.d, doc_id,
                  sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // t.terms))))::BIGINT AS score
           FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN held h ON h.d = counts.d, totals t
           GROUP BY i, item_id, h.d, doc_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES["op12_top_k_search"] = f"""
WITH whole AS ({WHOLE.format(label="")}),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op13_hard_negatives"] = f"""
WITH whole AS ({WHOLE.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,")} AND label IS NOT NULL),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
           FROM whole a JOIN whole c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                     row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
              FROM scored WHERE same),
negatives AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
                     (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank
              FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
                   AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
              WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
