"""DuckDB oracle SQL for product search (C8, C9): brute force over every
(query, product) pair, which is fine for a test oracle."""

from __future__ import annotations

from .queries_sql import CATALOG

TOKENS = "list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '')"
COLS = "id, name, available, brand_name, brand_id, stock_count, price, description"

SQL: dict[str, str] = {}
SQL["product_search"] = f"""
WITH {CATALOG},
p AS (SELECT c.*, {TOKENS} AS t FROM catalog c)
SELECT {COLS},
       CASE WHEN len(t) > 0 THEN CAST(len(list_filter(t, lambda x: x = 'red')) + len(list_filter(t, lambda x: x = 'blue'))
                                      AS DOUBLE) / len(t) END AS rank
FROM p WHERE list_contains(t, 'red') OR (list_contains(t, 'blue') AND NOT list_contains(t, 'small'))
"""
SQL["product_search_phrase"] = f"""
WITH {CATALOG},
p AS (SELECT c.*, {TOKENS} AS t FROM catalog c)
SELECT {COLS},
       CASE WHEN len(t) > 0 THEN CAST(len(list_filter(t, lambda x: x = 'hot')) + len(list_filter(t, lambda x: x = 'gear'))
                                      + len(list_filter(t, lambda x: x = 'widget')) AS DOUBLE) / len(t) END AS rank
FROM p WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' hot gear ') OR list_contains(t, 'widget')
"""

QUERIES = """
names AS (SELECT DISTINCT p_name AS n FROM part),
qs AS (SELECT 'and:' || n AS query_id, n AS query FROM names
       UNION ALL SELECT 'phrase:"' || n || '"', '"' || n || '"' FROM names
       UNION ALL SELECT 'or:' || split_part(n, ' ', 1) || ' or ' || split_part(n, ' ', 2),
                        split_part(n, ' ', 1) || ' or ' || split_part(n, ' ', 2) FROM names
       UNION ALL SELECT 'not:' || split_part(n, ' ', 2) || ' -' || split_part(n, ' ', 1),
                        split_part(n, ' ', 2) || ' -' || split_part(n, ' ', 1) FROM names
       UNION ALL SELECT 'mixed:' || split_part(n, ' ', 2) || ' or ' || split_part(n, ' ', 1) || ' -' || split_part(n, ' ', 2),
                        split_part(n, ' ', 2) || ' or ' || split_part(n, ' ', 1) || ' -' || split_part(n, ' ', 2) FROM names
       UNION ALL SELECT 'neg_or:-' || split_part(n, ' ', 1) || ' or ' || split_part(n, ' ', 2),
                        '-' || split_part(n, ' ', 1) || ' or ' || split_part(n, ' ', 2) FROM names
       UNION ALL SELECT 'neg:-' || split_part(n, ' ', 1), '-' || split_part(n, ' ', 1) FROM names)
"""

# The grammar: a query is cut at each ``or`` between blanks; each part is an AND of
# terms. (The stand-in phrases hold no ``or``.)
def evaluate(asked: str) -> str:
    """``res``: each of the terms' queries, that ``asked`` lets through, with every product."""
    return rf"""
br AS (SELECT query_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS branch
       FROM (SELECT DISTINCT query_id, string_split_regex(trim(query), '\s+or\s+') AS parts FROM qs) x),
tm AS (SELECT query_id, branch, unnest(regexp_extract_all(part, '(-?"[^"]*"|\S+)', 1)) AS term FROM br),
terms AS (SELECT query_id, branch, starts_with(term, '-') AS negated,
                 list_filter(string_split_regex(lower(term), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '') AS words FROM tm),
open_queries AS (SELECT DISTINCT query_id FROM (SELECT query_id FROM terms GROUP BY query_id, branch HAVING bool_and(negated)) x),
p AS (SELECT c.*, {TOKENS} AS t FROM catalog c),
ev AS (SELECT terms.query_id, terms.branch, p.id,
              bool_and(contains(' ' || array_to_string(p.t, ' ') || ' ', ' ' || array_to_string(words, ' ') || ' ') <> negated) AS ok,
              bool_and(negated) AS is_open,
              sum(CASE WHEN negated THEN 0 ELSE len(list_filter(p.t, lambda x: list_contains(words, x))) END) AS occ
       FROM (SELECT * FROM terms WHERE {asked}) terms, p GROUP BY terms.query_id, terms.branch, p.id),
res AS (SELECT query_id, id, bool_or(ok) AS ok, bool_or(is_open) AS is_open, sum(occ) AS occ FROM ev GROUP BY query_id, id)
"""

SQL["product_search_batch"] = f"""
WITH {CATALOG}, {QUERIES}, {evaluate("true")}
SELECT r.query_id, p.id, p.name, p.available, p.brand_name, p.brand_id, p.stock_count, p.price, p.description,
       CAST(r.occ AS DOUBLE) / len(p.t) AS rank,
       CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY CAST(r.occ AS DOUBLE) / len(p.t) DESC, p.id) AS INTEGER) AS position
FROM res r JOIN p ON p.id = r.id
WHERE r.ok AND NOT r.is_open
"""
SQL["product_search_unanchored"] = f"""
WITH {CATALOG}, {QUERIES}, {evaluate("query_id IN (SELECT query_id FROM open_queries)")}
SELECT qs.query_id, qs.query, true AS complement, x.id AS excluded_id
FROM qs LEFT JOIN (SELECT query_id, id FROM res WHERE NOT ok) x ON x.query_id = qs.query_id
WHERE qs.query_id IN (SELECT query_id FROM res WHERE is_open)
"""
SQL["product_search_index"] = SQL["product_search_batch"]
