"""Fixture definitions as DuckDB SQL (same text as FIXTURES.md).

The oracle inlines the fixtures a query reads as CTEs, in this order (a
definition may use the ones above it).
"""

from __future__ import annotations

import re

FIXTURE_SQL: dict[str, str] = {
    "brands": (
        'SELECT DISTINCT cast(substr(p_brand,7) as bigint) AS id, p_brand AS name FROM part'
    ),
    "product_types": (
        'SELECT cast(row_number() OVER (ORDER BY p_type) as bigint) AS id, p_type AS type FROM (SELECT DISTINCT p_type FROM part) t'
    ),
    "base_products": (
        "SELECT cast(row_number() OVER (ORDER BY p_brand, p_type) as bigint) AS id, concat(p_brand,' ',lower(p_type)) AS description, CASE WHEN p_type='PROMO' THEN NULL ELSE cast(substr(p_brand,7) as bigint) END AS brand_id, p_brand, p_type FROM (SELECT DISTINCT p_brand, p_type FROM part) t"
    ),
    "assigned_product_type": (
        'SELECT b.id AS product_id, t.id AS type_id FROM base_products b JOIN product_types t ON t.type=b.p_type UNION ALL SELECT b.id, t.id % 6 + 1 FROM base_products b JOIN product_types t ON t.type=b.p_type WHERE b.id % 2 = 0'
    ),
    "products": (
        "SELECT p.p_partkey AS id, p.p_name AS name, CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE concat('A ',p.p_name) END AS description, b.id AS base_product_id, p.p_partkey % 200 <> 0 AS available FROM part p JOIN base_products b ON b.p_brand=p.p_brand AND b.p_type=p.p_type"
    ),
    "product_stock_levels": (
        'SELECT p_partkey AS product_id, CASE WHEN p_partkey % 97 <> 0 THEN (cast(p_size as bigint)-1)*50 END AS amount FROM part'
    ),
    "price_change_log": (
        'SELECT l_partkey AS product_id, cast(l_shipdate as date) AS date_active_from, cast(round(l_extendedprice/l_quantity*100) as bigint) AS price_cents, l_orderkey AS seq_order, l_linenumber AS seq_line FROM lineitem'
    ),
    "product_prices": (
        'SELECT product_id, date_active_from, price_cents FROM (SELECT *, row_number() OVER (PARTITION BY product_id, date_active_from ORDER BY seq_order DESC, seq_line DESC, price_cents DESC) AS rn FROM price_change_log) t WHERE rn=1'
    ),
    "customer_accounts": (
        'SELECT c_custkey AS id, c_custkey AS account_id FROM customer'
    ),
    "staff_accounts": (
        "SELECT s_suppkey AS id, 1000000+s_suppkey AS account_id, CASE s_suppkey % 4 WHEN 0 THEN 'sale_accounts' WHEN 1 THEN 'admin_accounts' WHEN 2 THEN 'support_accounts' ELSE 'warehouse_accounts' END AS account_table FROM supplier"
    ),
    "accounts": (
        "SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN lower(c_name) ELSE concat(lower(replace(c_name,'#','.')),'@example.com') END AS email FROM customer UNION ALL SELECT 1000000+s_suppkey, concat(lower(replace(s_name,'#','.')),'@staff.example.com') FROM supplier"
    ),
    "shipping_countries": (
        'SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey <> 4'
    ),
    "shipping_addresses": (
        "SELECT CASE WHEN c_custkey % 13 = 0 THEN c_custkey*10+5 ELSE c_custkey*10 END AS id, c_custkey AS customer_id, concat('A',c_custkey % 100) AS area_code, c_name AS first_address_line, cast(NULL as varchar(9)) AS second_address_line, c_mktsegment AS state, CAST(c_nationkey AS BIGINT) AS country_id FROM customer UNION ALL SELECT c_custkey*10+1, c_custkey, concat('B',c_custkey % 100), c_name, 'Flat 2', c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 3 = 0"
    ),
    "default_shipping_address": (
        'SELECT customer_id, max(id) AS shipping_address_id FROM shipping_addresses WHERE customer_id % 2 = 0 GROUP BY customer_id'
    ),
    "order_statuses": (
        'SELECT cast(row_number() OVER (ORDER BY o_orderstatus) as bigint) AS id, o_orderstatus AS status FROM (SELECT DISTINCT o_orderstatus FROM orders) t'
    ),
    "shop_orders": (
        'SELECT o.o_orderkey AS id, o.o_custkey AS customer_id, CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE s.id END AS status_id, o.o_custkey*10 AS shipping_address_id, cast(round(o.o_totalprice*100) as bigint) AS price_paid_cents, o.o_orderdate AS placed_on FROM orders o JOIN order_statuses s ON s.status=o.o_orderstatus'
    ),
    "product_orders": (
        'SELECT l_orderkey AS order_id, l_partkey AS product_id, cast(l_quantity as bigint) AS quantity, cast(round(l_extendedprice/l_quantity*100) as bigint) AS price_cents FROM lineitem'
    ),
    "discount_codes": (
        "SELECT pct+1 AS id, concat('D',pct) AS code, pct*100 AS percent_bp, CASE WHEN pct % 4 = 0 THEN -1 WHEN pct % 4 = 1 THEN 0 ELSE pct*100 END AS number_of_uses, pct % 5 <> 0 AS active, pct % 3 <> 0 AS stackable FROM (SELECT DISTINCT cast(round(l_discount*100) as bigint) AS pct FROM lineitem) t"
    ),
    "discount_codes_for_order": (
        'SELECT DISTINCT l_orderkey AS order_id, cast(round(l_discount*100) as bigint)+1 AS discount_code_id FROM lineitem'
    ),
    "products_in_basket": (
        "SELECT o_custkey AS customer_id, l_partkey AS product_id, max(cast(l_quantity as bigint)) AS quantity FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY o_custkey, l_partkey"
    ),
    "checkout_requests": (
        "SELECT customer_id AS request_id, customer_id, customer_id*10 AS shipping_address_id, concat('D',customer_id % 12) AS code_1, CASE WHEN customer_id % 4 = 0 THEN concat('D',(customer_id+3) % 12) WHEN customer_id % 4 = 1 THEN concat('D',customer_id % 12) ELSE NULL END AS code_2 FROM (SELECT DISTINCT customer_id FROM products_in_basket) t"
    ),
    "view_events": (
        "SELECT event_id, ts, user_id AS customer_id, cast(regexp_extract(props,'[0-9]+',0) as bigint) AS product_id FROM events WHERE event_type='view'"
    ),
    "product_view_history": (
        'SELECT DISTINCT customer_id, product_id, cast(ts as date) AS date_viewed FROM view_events'
    ),
    "customer_favourite_products": (
        "SELECT DISTINCT user_id AS customer_id, cast(regexp_extract(props,'[0-9]+',0) as bigint) AS product_id FROM events WHERE event_type='click'"
    ),
    "basket_events": (
        "SELECT event_id, ts, user_id AS customer_id, cast(regexp_extract(props,'[0-9]+',0) as bigint) % 20 AS product_id, CASE event_type WHEN 'click' THEN 'add' WHEN 'signup' THEN 'update' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'clear' END AS op, 1 + event_id % 5 AS quantity FROM events WHERE event_type <> 'view'"
    ),
    "review_submissions": (
        "SELECT l_orderkey*10+l_linenumber AS seq, o_custkey AS customer_id, CASE WHEN l_orderkey % 11 = 0 THEN l_partkey+1 ELSE l_partkey END AS product_id, round(l_discount*100) + 0.5*(l_linenumber % 3) AS rating, concat('review ',l_returnflag,' ',l_linenumber) AS review, cast(l_shipdate as date) AS created_on FROM lineitem JOIN orders ON o_orderkey=l_orderkey"
    ),
    "product_questions": (
        "SELECT conv_id AS id, conv_id % 200 AS product_id, conv_id % 150 AS asked_by, text AS question FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations WHERE role='user') t WHERE rn=1"
    ),
    "product_question_answers": (
        "SELECT conv_id*1000+turn AS id, conv_id AS question_id, conv_id % 10 AS answered_by, text AS answer FROM conversations WHERE role='assistant'"
    ),
    "product_question_answers_rating": (
        "SELECT answer_id, customer_id, helpful FROM (SELECT cast(regexp_extract(props,'[0-9]+',0) as bigint)*1000+1 AS answer_id, user_id AS customer_id, value >= 20 AS helpful, row_number() OVER (PARTITION BY cast(regexp_extract(props,'[0-9]+',0) as bigint), user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type IN ('click','view')) t WHERE rn=1 AND answer_id IN (SELECT id FROM product_question_answers)"
    ),
    "product_images": (
        "SELECT page_id AS id, page_id % 20 AS product_id, concat('image-',page_id, CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.jpg' ELSE '.gif' END) AS source, CASE WHEN page_id % 6 = 0 THEN NULL ELSE page_id*7 % 10 END AS sort_position FROM pages"
    ),
    "filter_categories": (
        'SELECT cast(row_number() OVER (ORDER BY c_mktsegment) as bigint) AS id, c_mktsegment AS name FROM (SELECT DISTINCT c_mktsegment FROM customer) t'
    ),
}



def with_fixtures(body: str) -> str:
    """Prefix ``body`` with a WITH clause holding every fixture it needs."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, sql in FIXTURE_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(sql)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({s})" for n, s in FIXTURE_SQL.items() if n in needed)
    stripped = body.lstrip()
    if stripped[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{stripped[14:].lstrip()}"
    if stripped[:4].upper() == "WITH":
        return f"WITH {ctes},\n{stripped[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
