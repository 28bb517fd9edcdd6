"""DuckDB oracle SQL for checkout."""

from __future__ import annotations

from .queries_sql import CATALOG, NOW

REQ = """
req AS (SELECT request_id, customer_id, shipping_address_id,
               list_filter([code_1, code_2], lambda x: x IS NOT NULL) AS codes FROM checkout_requests),
cx AS (SELECT request_id, unnest(list_distinct(codes)) AS code FROM req),
ck AS (SELECT cx.request_id, count(d.id) AS n_known, bool_and(d.stackable) AS all_stack,
              CAST(sum(d.percent_bp) AS BIGINT) AS bp
       FROM cx LEFT JOIN discount_codes d ON d.code = cx.code GROUP BY cx.request_id),
chk AS (SELECT r.request_id, len(r.codes) AS n_raw, coalesce(ck.n_known, 0) AS n_known,
               coalesce(ck.n_known, 0) = len(r.codes) AND (coalesce(ck.n_known, 0) <= 1 OR coalesce(ck.all_stack, true))
                 AS codes_accepted,
               coalesce(ck.bp, 0) AS percent_bp_total
        FROM req r LEFT JOIN ck ON ck.request_id = r.request_id)
"""

LINES = f"""
{CATALOG},
lines AS (SELECT b.customer_id, b.product_id, b.quantity, (b.quantity <= c.stock_count AND c.available) AS available,
                 c.price_cents, c.price_cents / 100 AS price_per_item
          FROM products_in_basket b LEFT JOIN catalog c ON c.id = b.product_id),
verdict AS (SELECT customer_id, count(*) AS n_lines, NOT bool_or(coalesce(NOT available, false)) AS basket_valid
            FROM lines GROUP BY customer_id)
"""


def half_up(x):
    return f"(CASE WHEN ({x}) < 0 THEN -((abs({x}) + 5000) // 10000) ELSE (abs({x}) + 5000) // 10000 END)"


CHECKOUT = f"""
{REQ}, {LINES},
pre AS (SELECT r.request_id, r.customer_id, r.shipping_address_id, r.codes, chk.percent_bp_total,
               CASE WHEN NOT coalesce(chk.codes_accepted, false) THEN 'DISCOUNT_CODE_NOT_EXIST'
                    WHEN NOT EXISTS (SELECT 1 FROM shipping_addresses a WHERE a.id = r.shipping_address_id
                                     AND a.customer_id = r.customer_id) THEN 'SHIPPING_ADDRESS_INVALID' END AS pre
        FROM req r JOIN chk ON chk.request_id = r.request_id),
staged AS (SELECT request_id, customer_id,
                  row_number() OVER (PARTITION BY customer_id ORDER BY request_id) AS rk
           FROM pre WHERE pre IS NULL),
v0 AS (SELECT s.customer_id, coalesce(v.basket_valid, false) AS v0
       FROM staged s LEFT JOIN verdict v ON v.customer_id = s.customer_id WHERE s.rk = 1),
purged AS (SELECT DISTINCT l.product_id FROM lines l JOIN v0 ON v0.customer_id = l.customer_id
           WHERE NOT v0.v0 AND l.available = false),
after AS (SELECT * FROM lines WHERE product_id NOT IN (SELECT product_id FROM purged)),
b1 AS (SELECT customer_id, count(*) AS n FROM after GROUP BY customer_id),
st AS (SELECT p.*, s.rk,
              coalesce(p.pre, CASE WHEN s.rk = 1 THEN CASE WHEN v0.v0 THEN 'OK' ELSE 'BASKET_INVALID' END
                                   WHEN s.rk = 2 THEN CASE WHEN NOT v0.v0 AND coalesce(b1.n, 0) > 0 THEN 'OK'
                                                           ELSE 'BASKET_INVALID' END
                                   ELSE 'BASKET_INVALID' END) AS status,
              (SELECT max(id) FROM shop_orders) + p.request_id AS new_id
       FROM pre p LEFT JOIN staged s ON s.request_id = p.request_id
       LEFT JOIN v0 ON v0.customer_id = p.customer_id LEFT JOIN b1 ON b1.customer_id = p.customer_id),
seen AS (SELECT st.request_id, st.new_id, l.product_id, l.quantity, l.price_cents
         FROM st JOIN lines l ON l.customer_id = st.customer_id WHERE st.status = 'OK' AND st.rk = 1
         UNION ALL
         SELECT st.request_id, st.new_id, a.product_id, a.quantity, a.price_cents
         FROM st JOIN after a ON a.customer_id = st.customer_id WHERE st.status = 'OK' AND st.rk = 2),
tot AS (SELECT request_id, CAST(sum(coalesce(price_cents, 0) * quantity) AS BIGINT) AS total FROM seen
        GROUP BY request_id),
paid AS (SELECT st.*, {half_up("coalesce(tot.total, 0) * (10000 - st.percent_bp_total)")} AS price_paid_cents
         FROM st LEFT JOIN tot ON tot.request_id = st.request_id WHERE st.status = 'OK'),
links AS (SELECT p.new_id AS order_id, d.id AS discount_code_id
          FROM (SELECT new_id, unnest(list_distinct(codes)) AS code FROM paid) p
          JOIN discount_codes d ON d.code = p.code)
"""

SQL: dict[str, str] = {}
SQL["discount_set_check"] = f"WITH {REQ} SELECT * FROM chk"
SQL["basket_check"] = f"""WITH {LINES}
SELECT customer_id, product_id, quantity, available, price_cents, price_per_item FROM lines"""
SQL["basket_verdict"] = f"WITH {LINES} SELECT * FROM verdict"
SQL["order_pricing"] = f"""WITH {REQ}, {LINES},
tot AS (SELECT customer_id, CAST(sum(coalesce(price_cents, 0) * quantity) AS BIGINT) AS total FROM lines
        GROUP BY customer_id)
SELECT r.request_id, r.customer_id, t.total / 100 AS total,
       {half_up("t.total * (10000 - chk.percent_bp_total)")} / 100 AS discounted_total
FROM req r JOIN chk ON chk.request_id = r.request_id LEFT JOIN tot t ON t.customer_id = r.customer_id
"""
SQL["checkout_status"] = f"""WITH {CHECKOUT}
SELECT st.request_id, st.customer_id, st.status, CASE WHEN st.status = 'OK' THEN st.new_id END AS order_id,
       paid.price_paid_cents / 100 AS price_paid
FROM st LEFT JOIN paid ON paid.request_id = st.request_id
"""
SQL["checkout_orders"] = f"""WITH {CHECKOUT}
SELECT new_id AS id, customer_id, CAST(NULL AS BIGINT) AS status_id, shipping_address_id, price_paid_cents,
       {NOW} AS placed_on
FROM paid
"""
SQL["checkout_order_lines"] = f"""WITH {CHECKOUT}
SELECT new_id AS order_id, product_id, quantity, price_cents FROM seen
"""
SQL["checkout_code_links"] = f"WITH {CHECKOUT} SELECT order_id, discount_code_id FROM links"
SQL["checkout_stock"] = f"""WITH {CHECKOUT},
used AS (SELECT product_id, sum(quantity) AS q FROM seen GROUP BY product_id)
SELECT s.product_id, CAST(s.amount - coalesce(u.q, 0) AS BIGINT) AS amount
FROM product_stock_levels s LEFT JOIN used u ON u.product_id = s.product_id
"""
SQL["checkout_discount_codes"] = f"""WITH {CHECKOUT},
uses AS (SELECT discount_code_id, count(*) AS n FROM links GROUP BY discount_code_id)
SELECT d.id, d.code, d.percent_bp,
       CASE WHEN d.number_of_uses > 0 THEN greatest(d.number_of_uses - coalesce(u.n, 0), 0)
            ELSE d.number_of_uses END AS number_of_uses,
       d.active, d.stackable
FROM discount_codes d LEFT JOIN uses u ON u.discount_code_id = d.id
"""
SQL["checkout_basket"] = f"""WITH {CHECKOUT}
SELECT b.customer_id, b.product_id, b.quantity FROM products_in_basket b
WHERE b.customer_id NOT IN (SELECT customer_id FROM paid)
  AND b.product_id NOT IN (SELECT product_id FROM purged)
"""

SQL["checkout_feed_messages"] = f"""WITH {CHECKOUT},
left_basket AS (SELECT b.customer_id, b.product_id, b.quantity FROM products_in_basket b
                WHERE b.customer_id NOT IN (SELECT customer_id FROM paid)
                  AND b.product_id NOT IN (SELECT product_id FROM purged)),
lists AS (SELECT customer_id, list_sort(list({{'productId': product_id, 'quantity': quantity}})) AS basket
          FROM left_basket GROUP BY customer_id)
SELECT r.customer_id,
       CAST(to_json({{'type': 'basketUpdate', 'basket': coalesce(l.basket, []), 'part': 1, 'parts': 1}}) AS VARCHAR) AS message
FROM (SELECT DISTINCT customer_id FROM req) r LEFT JOIN lists l ON l.customer_id = r.customer_id
"""


# Baskets one at a time, in the order of the customers, carrying what is left of each product.
SERIAL = f"""
WITH RECURSIVE {CATALOG},
places AS (SELECT product_id, amount::BIGINT AS amount, row_number() OVER (ORDER BY product_id) AS place
           FROM product_stock_levels WHERE product_id IN (SELECT product_id FROM products_in_basket)),
wants AS (SELECT b.customer_id, p.place, sum(b.quantity)::BIGINT AS q, min(c.available) AS flag
          FROM products_in_basket b LEFT JOIN catalog c ON c.id = b.product_id LEFT JOIN places p ON p.product_id = b.product_id
          GROUP BY b.customer_id, b.product_id, p.place),
req AS MATERIALIZED (
  SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS rn, coalesce(bool_or(NOT flag), false) AS bad,
         coalesce(list(struct_pack(place := place, q := q)) FILTER (place IS NOT NULL), []) AS lines,
         map(coalesce(list(place) FILTER (place IS NOT NULL), []), coalesce(list(q) FILTER (place IS NOT NULL), [])) AS wanted
  FROM wants GROUP BY customer_id),
walk(rn, amounts, customer_id, allocated) AS (
  SELECT CAST(0 AS BIGINT), list(amount ORDER BY place), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN) FROM places
  UNION ALL
  SELECT n.rn, CASE WHEN j.ok THEN list_transform(w.amounts, lambda x, i: x - coalesce(n.wanted[i], 0)) ELSE w.amounts END, n.customer_id, j.ok
  FROM walk w JOIN req n ON n.rn = w.rn + 1,
  LATERAL (SELECT NOT n.bad AND len(list_filter(n.lines, lambda x: x.q > w.amounts[x.place])) = 0 AS ok) j
)
"""
SQL["checkout_serial"] = SERIAL + "SELECT customer_id, allocated FROM walk WHERE rn > 0"
SQL["checkout_serial_stock"] = SERIAL + """,
taken AS (SELECT customer_id FROM walk WHERE rn > 0 AND allocated),
used AS (SELECT b.product_id, sum(b.quantity) AS quantity FROM products_in_basket b JOIN taken USING (customer_id) GROUP BY b.product_id)
SELECT s.product_id, CAST(s.amount - coalesce(u.quantity, 0) AS BIGINT) AS amount FROM product_stock_levels s LEFT JOIN used u ON u.product_id = s.product_id
"""
