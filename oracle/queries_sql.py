"""DuckDB SQL per registered query, written independently of the Spark code.

Fixtures are referenced by name; ``oracle_sql()`` prefixes the CTEs they need.
Every computed column carries the same alias as the Spark result.
"""

from __future__ import annotations

from .fixtures_sql import with_fixtures

AS_OF = "DATE '1999-01-01'"
NOW = "TIMESTAMP '1999-01-01 12:00:00'"

# Shared CTE text: the catalogue (product view) priced on AS_OF.
CATALOG = f"""
price_now AS (
  SELECT product_id, arg_max(price_cents, date_active_from) AS price_cents,
         max(date_active_from) AS price_date
  FROM product_prices WHERE date_active_from <= {AS_OF} GROUP BY product_id),
catalog AS (
  SELECT p.id, p.name, p.description, p.base_product_id, b.brand_id, br.name AS brand_name,
         p.available, s.amount AS stock_count, pr.price_cents, pr.price_cents / 100 AS price
  FROM products p
  LEFT JOIN base_products b ON p.base_product_id = b.id
  LEFT JOIN brands br ON b.brand_id = br.id
  LEFT JOIN product_stock_levels s ON p.id = s.product_id
  LEFT JOIN price_now pr ON p.id = pr.product_id)
"""

SQL: dict[str, str] = {}

# ---- catalogue -------------------------------------------------------------
SQL["price_as_of"] = f"""
SELECT product_id, arg_max(price_cents, date_active_from) AS price_cents,
       max(date_active_from) AS price_date
FROM product_prices WHERE date_active_from <= {AS_OF} GROUP BY product_id
"""

SQL["product_catalog"] = f"WITH {CATALOG} SELECT * FROM catalog"

SQL["products_by_type"] = f"""
WITH {CATALOG}
SELECT a.type_id, c.id, c.name, c.description, c.brand_id, c.brand_name, c.available, c.stock_count, c.price
FROM catalog c JOIN assigned_product_type a ON c.base_product_id = a.product_id
"""

SQL["products_by_brand"] = f"""
WITH {CATALOG}
SELECT id, name, description, brand_id, brand_name, available, stock_count, price
FROM catalog WHERE brand_id IS NOT NULL
"""

SQL["product_detail"] = f"""
WITH {CATALOG}
SELECT id, name, available, brand_name, brand_id, stock_count, price, description FROM catalog
"""

SQL["price_on_days"] = """
SELECT r.request_id, r.product_id, r.day, p.price_cents, p.date_active_from AS price_date
FROM (SELECT DISTINCT l_orderkey * 1000000000 + l_partkey AS request_id, l_partkey AS product_id, CAST(o_orderdate AS DATE) AS day
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) r
ASOF LEFT JOIN product_prices p ON p.product_id = r.product_id AND p.date_active_from <= r.day
"""

SQL["products_same_style"] = f"""
WITH {CATALOG}
SELECT s.s_suppkey AS request_id, asked.id AS requested_id, c.id, c.name, c.available, c.stock_count, c.price
FROM supplier s JOIN products asked ON asked.id = s.s_suppkey * 7 % 1500 + 1
JOIN catalog c ON c.base_product_id = asked.base_product_id
"""

SQL["random_products"] = f"""
WITH {CATALOG}
SELECT id, name, available, stock_count, price FROM catalog ORDER BY md5('7:' || id), id LIMIT 10
"""

SQL["request_list_check"] = """
WITH odd AS (SELECT ['7', '-1.5e3', 'NaN', '', '  ', '0x1F', '0b12', '1d', '.5', '5.', '.', 'Infinity', '-Infinity', 'inf', ' 12' || chr(9),
                     '1 2', '1_000', 'Brand', NULL] AS texts,
                    [true, true, false, true, true, true, false, false, true, true, false, true, true, false, true,
                     false, false, false, true] AS fine)
SELECT p_partkey AS request_id, p_partkey % 17 <> 0 AND fine[p_partkey % 19 + 1] AS numbers,
       p_partkey % 17 <> 0 AND texts[p_partkey % 19 + 1] IS NOT NULL AS strings
FROM part, odd
"""

SQL["style_index"] = f"""
WITH {CATALOG}
SELECT c.id, c.name, c.available, c.stock_count, c.price, c.base_product_id AS style_id,
       count(*) OVER (PARTITION BY c.base_product_id) AS n_variants
FROM catalog c
"""

# ---- orders ----------------------------------------------------------------
SQL["orders_with_products"] = """
SELECT o.id AS order_id, o.customer_id, o.placed_on AS order_placed_on, po.product_id, po.quantity,
       po.price_cents AS item_price_cents
FROM shop_orders o JOIN product_orders po ON po.order_id = o.id
"""

# Lines are summed up per order first; an order whose address is gone is left out.
ORDER_SUMS = """
sums AS (SELECT order_id, count(product_id) AS n, CAST(sum(price_cents * quantity) AS BIGINT) AS cents FROM product_orders GROUP BY order_id),
placed AS (SELECT *, (SELECT any_value(s.status) FROM order_statuses s WHERE s.id = status_id) AS status FROM shop_orders
           WHERE EXISTS (SELECT 1 FROM shipping_addresses a WHERE a.id = shipping_address_id))
"""
SQL["order_history"] = f"""
WITH {ORDER_SUMS}
SELECT id, customer_id, status, shipping_address_id, coalesce(n, 0) AS product_count, cents / 100 AS total,
       price_paid_cents / 100 AS price_paid, placed_on
FROM placed LEFT JOIN sums ON order_id = id
"""

SQL["order_details"] = f"""
WITH {ORDER_SUMS}
SELECT id, customer_id, status, coalesce(n, 0) AS product_count, cents / 100 AS total, price_paid_cents / 100 AS price_paid, placed_on
FROM placed LEFT JOIN sums ON order_id = id
"""

SQL["order_products"] = """
SELECT po.order_id, o.customer_id, po.product_id, p.name AS product_name, po.quantity,
       po.price_cents / 100 AS price
FROM shop_orders o JOIN product_orders po ON po.order_id = o.id
LEFT JOIN products p ON p.id = po.product_id
"""

SQL["order_discounts"] = """
WITH used AS (SELECT order_id, (SELECT any_value(code) FROM discount_codes d WHERE d.id = discount_code_id) AS code FROM discount_codes_for_order)
SELECT id AS order_id, customer_id, code FROM shop_orders JOIN used ON used.order_id = shop_orders.id WHERE customer_id IS NOT NULL
"""

SQL["last_purchase"] = """
SELECT o.customer_id, po.product_id, max(o.placed_on) AS last_purchased_on
FROM shop_orders o JOIN product_orders po ON po.order_id = o.id
GROUP BY o.customer_id, po.product_id
"""

SQL["discount_validation"] = """
SELECT id, code, (number_of_uses <> 0 AND active) AS valid, percent_bp / 100 AS percent, stackable
FROM discount_codes
"""

# ---- lookups ---------------------------------------------------------------
SQL["lookup_brands"] = "SELECT id, name FROM brands"
SQL["lookup_product_types"] = "SELECT id, type FROM product_types"
SQL["lookup_filter_categories"] = "SELECT id, name FROM filter_categories"
SQL["lookup_order_statuses"] = "SELECT id, status FROM order_statuses"
SQL["lookup_countries"] = "SELECT id, name FROM shipping_countries"
SQL["lookup_brand_by_id"] = """
SELECT b.id AS base_product_id, b.brand_id, br.name
FROM base_products b LEFT JOIN brands br ON br.id = b.brand_id
"""
SQL["lookup_product_type_by_id"] = """
SELECT a.product_id, a.type_id, t.type FROM assigned_product_type a LEFT JOIN product_types t ON t.id = a.type_id
"""
SQL["all_product_ids"] = "SELECT id FROM products"

# ---- history and favourites -------------------------------------------------
SQL["recent_views"] = """
WITH newest AS (SELECT customer_id, product_id, max(date_viewed) AS date_viewed FROM product_view_history GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY date_viewed DESC, product_id) AS position
FROM newest QUALIFY position <= 20
"""
SQL["viewed_on_day"] = """
SELECT f.customer_id, f.product_id,
       EXISTS (SELECT 1 FROM product_view_history h
               WHERE h.customer_id = f.customer_id AND h.product_id = f.product_id
                 AND h.date_viewed = DATE '2024-01-15') AS viewed
FROM customer_favourite_products f
"""
SQL["favourites"] = "SELECT customer_id, product_id FROM customer_favourite_products"
SQL["has_favourited"] = """
SELECT p.customer_id, p.product_id,
       EXISTS (SELECT 1 FROM customer_favourite_products f
               WHERE f.customer_id = p.customer_id AND f.product_id = p.product_id) AS favourited
FROM (SELECT DISTINCT customer_id, product_id FROM product_view_history) p
"""

# ---- questions and answers --------------------------------------------------
SQL["product_questions"] = "SELECT id, product_id, asked_by, question FROM product_questions"
SQL["helpful_counts"] = """
SELECT answer_id, helpful, count(*) AS count FROM product_question_answers_rating GROUP BY answer_id, helpful
"""
SQL["answers_ranked"] = """
SELECT a.id, a.question_id, a.answer, a.answered_by,
       CAST(coalesce((SELECT count(*) FILTER (WHERE r.helpful) - count(*) FILTER (WHERE NOT r.helpful)
                      FROM product_question_answers_rating r WHERE r.answer_id = a.id), 0) AS BIGINT)
         AS overall_rating
FROM product_question_answers a
"""
SQL["answer_rating"] = """
SELECT a.id AS answer_id, q.asked_by AS customer_id,
       CAST((SELECT count(*) FILTER (WHERE r.helpful) - count(*) FILTER (WHERE NOT r.helpful)
             FROM product_question_answers_rating r WHERE r.answer_id = a.id) AS BIGINT) AS rating,
       (SELECT r.helpful FROM product_question_answers_rating r
        WHERE r.answer_id = a.id AND r.customer_id = q.asked_by) AS user_found_helpful
FROM product_question_answers a JOIN product_questions q ON a.question_id = q.id
"""

# ---- addresses and accounts -------------------------------------------------
SQL["customer_addresses"] = """
SELECT a.id, a.customer_id, a.area_code, a.first_address_line, a.second_address_line, a.state, a.country_id,
       c.name AS country_name
FROM shipping_addresses a LEFT JOIN shipping_countries c ON c.id = a.country_id
"""
SQL["default_addresses"] = """
SELECT d.customer_id, a.id, a.area_code, a.first_address_line, a.second_address_line, a.state, a.country_id,
       c.name AS country_name
FROM default_shipping_address d
LEFT JOIN shipping_addresses a ON a.id = d.shipping_address_id
LEFT JOIN shipping_countries c ON c.id = a.country_id
"""
SQL["account_types"] = """
WITH roles AS (
  SELECT 'customer_accounts' AS account_table, id AS role_id, account_id FROM customer_accounts
  UNION ALL SELECT account_table, id, account_id FROM staff_accounts),
tabs AS (SELECT unnest(['customer_accounts', 'admin_accounts', 'sale_accounts', 'support_accounts',
                        'warehouse_accounts']) AS account_table)
SELECT a.id AS account_id, t.account_table, r.role_id, r.role_id IS NOT NULL AS is_account_type
FROM accounts a CROSS JOIN tabs t
LEFT JOIN roles r ON r.account_id = a.id AND r.account_table = t.account_table
"""
SQL["account_lookup"] = """
SELECT c.c_custkey AS request_id, concat(lower(replace(c.c_name, '#', '.')), '@example.com') AS email,
       a.id AS account_id
FROM customer c LEFT JOIN accounts a ON a.email = concat(lower(replace(c.c_name, '#', '.')), '@example.com')
"""
SQL["account_email"] = """
SELECT a.id AS answer_id, a.answered_by AS account_id, acc.email
FROM product_question_answers a LEFT JOIN accounts acc ON acc.id = a.answered_by
"""
# Fixed value: the e-mail pattern.
SQL["email_check"] = r"""
SELECT id, email,
  regexp_matches(email, '^(([^<>()\[\]\\.,;:\s@"]+(\.[^<>()\[\]\\.,;:\s@"]+)*)|(".+"))@((\[[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}])|(([a-zA-Z\-0-9]+\.)+[a-zA-Z]{2,}))$')
  AS valid_email
FROM accounts
"""

# ---- images -----------------------------------------------------------------
SQL["product_images"] = "SELECT id, product_id, source AS file_name, sort_position FROM product_images"
SQL["image_type_check"] = r"""
SELECT id, product_id, source,
       coalesce(regexp_extract(source, '^.+(\.[^.]*)$', 1), '') AS extension,
       coalesce(regexp_extract(source, '^.+(\.[^.]*)$', 1), '') IN ('.png', '.jpeg', '.jpg') AS accepted
FROM product_images
"""


def oracle_sql() -> dict[str, str]:
    from .changes_sql import SQL as CHANGES
    from .checkout_sql import SQL as CHECKOUT
    from .search_sql import SQL as SEARCH

    merged = {**SQL, **CHANGES, **CHECKOUT, **SEARCH}
    return {name: with_fixtures(body) for name, body in merged.items()}
