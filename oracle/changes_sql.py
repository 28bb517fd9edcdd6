"""DuckDB oracle SQL for the keyed-change queries.

W1 / W2 / W3 are written once as SQL templates (windows and EXISTS, a
different formulation from the Spark joins) and instantiated per query.
"""

from __future__ import annotations

LOWEST = "-9223372036854775808"


def _fk_ok(fks, alias="b"):
    if not fks:
        return "TRUE"
    return " AND ".join(
        f"({alias}.{c} IS NULL OR EXISTS (SELECT 1 FROM {pt} p WHERE p.{pc} = {alias}.{c}))" for c, pt, pc in fks)


def _match(cols, left, right):
    return " AND ".join(f"{left}.{c} = {right}.{c}" for c in cols)


def w1(batch, target, unique, fks, out_cols, id_expr=None):
    """Insert with unique key and FKs; returns out_cols [, id], outcome."""
    idc = f", CASE WHEN outcome = 'OK' THEN {id_expr} END AS id" if id_expr else ""
    if unique:
        knn = " AND ".join(f"b.{k} IS NOT NULL" for k in unique)
        part = ", ".join(unique)
        return f"""
WITH b0 AS ({batch}),
f AS (SELECT b.*, {_fk_ok(fks)} AS fk_ok,
             EXISTS (SELECT 1 FROM {target} t WHERE {_match(unique, 't', 'b')}) AS taken,
             ({knn}) AS knn
      FROM b0 b),
g AS (SELECT f.*, min(CASE WHEN fk_ok AND NOT taken AND knn THEN seq END)
                  OVER (PARTITION BY {part}) AS first_ok FROM f),
o AS (SELECT g.*, CASE
        WHEN NOT fk_ok THEN CASE WHEN knn AND (taken OR coalesce(first_ok < seq, false)) THEN 'CONFLICT'
                                 ELSE 'FOREIGN_KEY_VIOLATION' END
        WHEN NOT knn THEN 'OK' WHEN taken THEN 'CONFLICT' WHEN seq = first_ok THEN 'OK'
        ELSE 'CONFLICT' END AS outcome FROM g)
SELECT {out_cols}{idc}, outcome FROM o
"""
    return f"""
WITH b0 AS ({batch}),
o AS (SELECT b.*, CASE WHEN {_fk_ok(fks)} THEN 'OK' ELSE 'FOREIGN_KEY_VIOLATION' END AS outcome FROM b0 b)
SELECT {out_cols}{idc}, outcome FROM o
"""


def _w2_core(batch, target, key, fks):
    ex = f"EXISTS (SELECT 1 FROM {target} t WHERE {_match(key, 't', 'b')})"
    return f"""
WITH b0 AS ({batch}),
f AS (SELECT b.*, {ex} AS ex, {_fk_ok(fks)} AS fk_ok FROM b0 b),
o AS (SELECT f.*, CASE WHEN NOT ex THEN 'DOES_NOT_EXIST' WHEN NOT fk_ok THEN 'FOREIGN_KEY_VIOLATION'
                       ELSE 'OK' END AS outcome FROM f)
"""


def _rename_walk(batch, target, value):
    """Renames onto a unique column, one statement per step, carrying every row's current value."""
    return f"""
WITH RECURSIVE
b AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM ({batch}) b0),
walk(rn, ids, held, seq, id, {value}, outcome) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(id ORDER BY id) FROM {target}), (SELECT list({value} ORDER BY id) FROM {target}),
         CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
  UNION ALL
  SELECT b.rn, w.ids, CASE WHEN j.o = 'OK' THEN list_concat(list_append(w.held[1:j.spot - 1], b.{value}), w.held[j.spot + 1:len(w.held)]) ELSE w.held END,
         b.seq, b.id, b.{value}, j.o
  FROM walk w JOIN b ON b.rn = w.rn + 1,
  LATERAL (SELECT spot, CASE WHEN spot = 0 THEN 'DOES_NOT_EXIST' WHEN holder NOT IN (0, spot) THEN 'CONFLICT' ELSE 'OK' END AS o
           FROM (SELECT coalesce(list_position(w.ids, b.id), 0) AS spot,
                        CASE WHEN b.{value} IS NULL THEN 0 ELSE coalesce(list_position(w.held, b.{value}), 0) END AS holder) p) j
)
"""


def rename(batch, target, value):
    return _rename_walk(batch, target, value) + f"SELECT seq, id, {value}, outcome FROM walk WHERE rn > 0\n"


def rename_table(batch, target, value):
    return _rename_walk(batch, target, value) + f"""
SELECT unnest(ids) AS id, unnest(held) AS {value} FROM walk WHERE rn = (SELECT max(rn) FROM walk)
"""


def w2(batch, target, key, fks, out_cols):
    return _w2_core(batch, target, key, fks) + f"SELECT {out_cols}, outcome FROM o\n"


def w2_table(batch, target, key, fks, set_cols, table_cols):
    core = _w2_core(batch, target, key, fks)
    packed = ", ".join(f"'{c}': {c}" for c in set_cols)
    kc = ", ".join(key)
    sel = ", ".join(f"CASE WHEN l.{key[0]} IS NOT NULL THEN l.s.{c} ELSE t.{c} END AS {c}" if c in set_cols
                    else f"t.{c}" for c in table_cols)
    return core + f""",
l AS (SELECT {kc}, arg_max({{{packed}}}, seq) AS s FROM o WHERE outcome = 'OK' GROUP BY {kc})
SELECT {sel} FROM {target} t LEFT JOIN l ON {_match(key, 'l', 't')}
"""


def w3(batch, target, key, out_cols, missing_ok=False):
    part = ", ".join(key)
    ok = "TRUE" if missing_ok else "present AND seq = first_hit"
    return f"""
WITH b0 AS ({batch}),
f AS (SELECT b.*, EXISTS (SELECT 1 FROM {target} t WHERE {_match(key, 't', 'b')}) AS present FROM b0 b),
g AS (SELECT f.*, min(CASE WHEN present THEN seq END) OVER (PARTITION BY {part}) AS first_hit FROM f)
SELECT {out_cols}, CASE WHEN {ok} THEN 'OK' ELSE 'DOES_NOT_EXIST' END AS outcome FROM g
"""


K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"


_EVENT_PAIRS = f"SELECT event_id AS seq, user_id AS customer_id, {K} AS product_id FROM events"
_VOTES = f"SELECT event_id AS seq, {K} * 1000 + 1 AS answer_id, user_id AS customer_id, value >= 20 AS helpful FROM events"


SUBMISSIONS = """
SELECT seq * (SELECT greatest(max(n), 100) FROM (SELECT count(*) AS n FROM review_submissions GROUP BY seq) c) + row_number() OVER (PARTITION BY seq ORDER BY customer_id NULLS FIRST, product_id NULLS FIRST,
         rating NULLS FIRST, review NULLS FIRST, created_on NULLS FIRST) - 1 AS seq,
       customer_id, product_id, rating, review, created_on
FROM review_submissions
"""

REVIEWS_CTE = f"""
subs AS ({SUBMISSIONS}),
bought AS (SELECT DISTINCT o.customer_id, po.product_id FROM product_orders po JOIN shop_orders o ON o.id = po.order_id),
gated AS (SELECT s.*, CASE WHEN NOT coalesce(rating >= 0 AND rating <= 10, false) THEN 'REJECTED'
                           WHEN NOT EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = s.customer_id
                                            AND b.product_id = s.product_id) THEN 'NOT_PURCHASED' END AS gate
          FROM subs s),
cand AS (SELECT g.*, EXISTS (SELECT 1 FROM products p WHERE p.id = g.product_id)
                     AND EXISTS (SELECT 1 FROM customer_accounts c WHERE c.id = g.customer_id) AS fk_ok
         FROM gated g WHERE gate IS NULL),
firsts AS (SELECT cand.*, min(CASE WHEN fk_ok THEN seq END) OVER (PARTITION BY customer_id, product_id) AS first_ok
           FROM cand),
judged AS (SELECT seq, CASE WHEN NOT fk_ok THEN CASE WHEN coalesce(first_ok < seq, false) THEN 'CONFLICT'
                                                     ELSE 'FOREIGN_KEY_VIOLATION' END
                            WHEN seq = first_ok THEN 'OK' ELSE 'CONFLICT' END AS outcome FROM firsts),
reviews AS (SELECT s.seq AS id, s.customer_id, s.product_id, CAST(floor(s.rating) AS BIGINT) AS rating,
                   s.review AS text, s.created_on, CAST(NULL AS DATE) AS updated_on
            FROM subs s JOIN judged j ON j.seq = s.seq WHERE j.outcome = 'OK')
"""

BASKET_CTE = f"""
ev AS (SELECT event_id AS seq, customer_id, product_id, op, quantity,
              (op NOT IN ('add', 'update') OR coalesce(quantity > 0, false)) AS valid,
              EXISTS (SELECT 1 FROM products p WHERE p.id = e.product_id)
              AND EXISTS (SELECT 1 FROM customer_accounts c WHERE c.id = e.customer_id) AS fk
       FROM basket_events e),
pe AS (SELECT seq, customer_id, product_id, op, quantity, valid, fk, false AS opening,
              CASE WHEN op = 'add' AND valid AND fk THEN 1 WHEN op = 'remove' THEN 0 END AS flag
       FROM ev WHERE op <> 'clear'
       UNION ALL
       SELECT {LOWEST}, customer_id, product_id, 'open', quantity, true, true, true, 1 FROM products_in_basket),
pa AS (SELECT pe.*, max(CASE WHEN flag IS NOT NULL THEN seq END) OVER (
                 PARTITION BY customer_id, product_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               AS a_seq FROM pe),
pb AS (SELECT pa.*, f.flag AS a_flag FROM pa LEFT JOIN pe f
       ON f.customer_id = pa.customer_id AND f.product_id = pa.product_id AND f.seq = pa.a_seq),
kc AS (SELECT seq, customer_id, op, max(CASE WHEN op = 'clear' THEN seq END) OVER (
                 PARTITION BY customer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k
       FROM ev),
pp AS (SELECT pb.*, kc.k, coalesce(pb.a_flag = 1, false) AND (kc.k IS NULL OR pb.a_seq > kc.k) AS present
       FROM pb LEFT JOIN kc ON kc.seq = pb.seq AND kc.customer_id = pb.customer_id),
po AS (SELECT pp.*, CASE WHEN opening THEN 'OK' WHEN NOT valid THEN 'REJECTED'
                         WHEN op = 'add' THEN CASE WHEN present THEN 'CONFLICT'
                                                   WHEN NOT fk THEN 'FOREIGN_KEY_VIOLATION' ELSE 'OK' END
                         WHEN present THEN 'OK' ELSE 'DOES_NOT_EXIST' END AS outcome FROM pp),
net AS (SELECT customer_id, coalesce(k, {LOWEST}) AS epoch,
               sum(CASE WHEN opening THEN 1 WHEN op = 'add' AND outcome = 'OK' THEN 1
                        WHEN op = 'remove' AND outcome = 'OK' THEN -1 ELSE 0 END) AS n
        FROM po GROUP BY 1, 2),
co AS (SELECT kc.seq, CASE WHEN coalesce(net.n, 0) > 0 THEN 'OK' ELSE 'DOES_NOT_EXIST' END AS outcome
       FROM kc LEFT JOIN net ON net.customer_id = kc.customer_id AND net.epoch = coalesce(kc.k, {LOWEST})
       WHERE kc.op = 'clear')
"""

EMAIL_RE = (r'^(([^<>()\[\]\\.,;:\s@"]+(\.[^<>()\[\]\\.,;:\s@"]+)*)|(".+"))@'
            r'((\[[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}])|(([a-zA-Z\-0-9]+\.)+[a-zA-Z]{2,}))$')

SORT_REQ = """
r AS (SELECT page_id AS seq, page_id % 20 AS product_id,
             CASE WHEN page_id % 3 = 0 THEN [page_id, page_id + 1] ELSE [page_id + 40, page_id, page_id + 20] END AS ids
      FROM pages),
items AS (SELECT r.seq, r.product_id, r.ids[i + 1] AS id, i AS pos FROM r, range(len(r.ids)) t(i)),
v AS (SELECT items.seq, bool_and(coalesce(im.product_id = items.product_id, false)) AS ok
      FROM items LEFT JOIN product_images im ON im.id = items.id GROUP BY items.seq)
"""

SQL: dict[str, str] = {}

# ---- brands and types
_BRAND_NEW = "SELECT p_partkey AS seq, trim(concat('  Brand#', CAST(p_size AS VARCHAR), ' ')) AS name FROM part"
SQL["brand_create"] = w1(_BRAND_NEW, "brands", ["name"], [], "seq, name",
                         "CAST((SELECT coalesce(max(id), 0) FROM brands) + seq AS BIGINT)")
_BRAND_REN = ("SELECT p_partkey AS seq, CAST(p_partkey % 30 AS BIGINT) AS id, "
              "trim(concat('Brand#', CAST(p_size AS VARCHAR))) AS name FROM part")
SQL["brand_rename"] = rename(_BRAND_REN, "brands", "name")
SQL["brand_rename_table"] = rename_table(_BRAND_REN, "brands", "name")
SQL["brand_delete"] = w3("SELECT p_partkey AS seq, CAST(p_size AS BIGINT) AS id FROM part", "brands", ["id"],
                         "seq, id")


def delete_parents(batch, root, refused):
    """Deletes of ``root`` rows; ``refused`` is a condition on the row ``r``."""
    return f"""
WITH b0 AS ({batch}),
f AS (SELECT b0.*, r.id IS NOT NULL AS present, coalesce({refused}, false) AS refused, min(b0.seq) OVER (PARTITION BY b0.id) AS first_seq
      FROM b0 LEFT JOIN {root} r ON r.id = b0.id)
SELECT seq, id, CASE WHEN NOT present THEN 'DOES_NOT_EXIST' WHEN refused THEN 'FOREIGN_KEY_VIOLATION'
                     WHEN seq = first_seq THEN 'OK' ELSE 'DOES_NOT_EXIST' END AS outcome FROM f
"""


_BRAND_DEL = "SELECT p_partkey AS seq, CAST(p_size AS BIGINT) AS id FROM part"
_BASE_DEL = "SELECT p_partkey AS seq, CAST(p_partkey % 200 AS BIGINT) AS id FROM part"
_HELD = "SELECT product_id FROM product_orders UNION ALL SELECT product_id FROM products_in_basket"
SQL["brand_delete_restrict"] = delete_parents(_BRAND_DEL, "brands", "r.id IN (SELECT brand_id FROM base_products WHERE brand_id IS NOT NULL)")
SQL["brand_delete_cascade"] = delete_parents(
    _BRAND_DEL, "brands", f"r.id IN (SELECT bp.brand_id FROM base_products bp JOIN products p ON p.base_product_id = bp.id WHERE p.id IN ({_HELD}) AND bp.brand_id IS NOT NULL)")
SQL["brand_delete_cascade_prices"] = """
SELECT * FROM product_prices WHERE product_id NOT IN (
  SELECT p.id FROM products p JOIN base_products bp ON bp.id = p.base_product_id JOIN brands b ON b.id = bp.brand_id
  WHERE b.id > 10 AND b.id IN (SELECT p_size FROM part))
"""
SQL["base_product_delete_restrict"] = delete_parents(
    _BASE_DEL, "base_products", "(r.id IN (SELECT base_product_id FROM products WHERE base_product_id IS NOT NULL) OR r.id IN (SELECT product_id FROM assigned_product_type))")
SQL["base_product_delete_cascade"] = delete_parents(
    _BASE_DEL, "base_products", f"r.id IN (SELECT base_product_id FROM products WHERE base_product_id IS NOT NULL AND id IN ({_HELD}))")
SQL["product_type_create"] = w1(
    "SELECT p_partkey AS seq, trim(concat(' ', upper(split_part(p_name, ' ', 2)))) AS type FROM part",
    "product_types", ["type"], [], "seq, type",
    "CAST((SELECT coalesce(max(id), 0) FROM product_types) + seq AS BIGINT)")
SQL["product_type_rename"] = rename(
    "SELECT p_partkey AS seq, CAST(p_partkey % 8 AS BIGINT) AS id, upper(split_part(p_name, ' ', 1)) AS type "
    "FROM part", "product_types", "type")
SQL["product_type_delete"] = w3("SELECT p_partkey AS seq, CAST(p_partkey % 9 AS BIGINT) AS id FROM part",
                                "product_types", ["id"], "seq, id")

# ---- base products
SQL["base_product_create"] = """
SELECT s_suppkey + 1 AS seq,
       CASE WHEN NOT EXISTS (SELECT 1 FROM brands b WHERE b.id = s.s_nationkey) THEN 'FOREIGN_KEY_VIOLATION'
            WHEN NOT EXISTS (SELECT 1 FROM product_types t WHERE t.id = s.s_suppkey % 7 + 1)
              OR NOT EXISTS (SELECT 1 FROM product_types t WHERE t.id = (s.s_suppkey + 2) % 7 + 1)
            THEN 'FOREIGN_KEY_VIOLATION' ELSE 'OK' END AS outcome
FROM supplier s
"""
SQL["base_product_delete"] = w3("SELECT p_partkey AS seq, CAST(p_partkey % 200 AS BIGINT) AS id FROM part",
                                "base_products", ["id"], "seq, id")
_BRAND_SET = ("SELECT p_partkey AS seq, CAST(p_partkey % 160 AS BIGINT) AS id, "
              "CAST(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS BIGINT) AS brand_id FROM part")
SQL["base_product_set_brand"] = w2(_BRAND_SET, "base_products", ["id"], [("brand_id", "brands", "id")],
                                   "seq, id, brand_id")
SQL["base_product_set_brand_table"] = w2_table(_BRAND_SET, "base_products", ["id"], [("brand_id", "brands", "id")], ["brand_id"],
                                               ["id", "description", "brand_id"])
SQL["base_product_description"] = w2(
    "SELECT p_partkey AS seq, CAST(p_partkey % 170 AS BIGINT) AS id, trim(concat(p_type, ' ', p_name)) AS description "
    "FROM part", "base_products", ["id"], [], "seq, id, description")
SQL["unassign_types"] = w3(
    "SELECT p_partkey AS seq, CAST(p_partkey % 150 + 1 AS BIGINT) AS product_id, "
    "CAST(p_size % 7 + 1 AS BIGINT) AS type_id FROM part",
    "assigned_product_type", ["product_id", "type_id"], "seq, product_id, type_id", missing_ok=True)

# ---- products, prices, order status
SQL["product_create"] = """
SELECT p_partkey + 1 AS seq,
       CASE WHEN EXISTS (SELECT 1 FROM base_products b WHERE b.id = p.p_partkey % 170 + 1) THEN 'OK'
            ELSE 'FOREIGN_KEY_VIOLATION' END AS outcome
FROM part p
"""
SQL["product_rename"] = w2("SELECT p_partkey AS seq, p_partkey * 3 AS id, trim(upper(p_name)) AS name FROM part",
                           "products", ["id"], [], "seq, id, name")
_DESC = ("SELECT p_partkey AS seq, p_partkey % 2500 AS id, "
         "trim(CASE WHEN p_size % 4 = 0 THEN NULL ELSE concat('  New ', p_name) END) AS description FROM part")
SQL["product_description"] = w2(_DESC, "products", ["id"], [], "seq, id, description")
SQL["product_description_table"] = w2_table(_DESC, "products", ["id"], [], ["description"],
                                            ["id", "name", "description", "base_product_id", "available"])
SQL["price_set"] = """
WITH log AS (SELECT product_id, date_active_from + CAST(seq_order % 2 AS INTEGER) AS date_active_from, price_cents + 100 AS price_cents, seq_order, seq_line
             FROM price_change_log l WHERE EXISTS (SELECT 1 FROM products p WHERE p.id = l.product_id)),
last AS (SELECT product_id, date_active_from, arg_max(price_cents, row(seq_order, seq_line, price_cents)) AS price_cents FROM log GROUP BY ALL)
SELECT product_id, date_active_from, price_cents FROM last
UNION ALL SELECT product_id, date_active_from, price_cents FROM product_prices pp
WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.product_id = pp.product_id AND l.date_active_from = pp.date_active_from)
"""
SQL["order_status_update"] = w2(
    "SELECT o_orderkey AS seq, o_orderkey + 1 AS id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS status_id "
    "FROM orders", "shop_orders", ["id"], [("status_id", "order_statuses", "id")], "seq, id, status_id")

# ---- basket
SQL["basket_contents"] = "SELECT customer_id, product_id, quantity FROM products_in_basket"
SQL["basket_change_filter"] = """
SELECT event_id AS seq, op, quantity, (op NOT IN ('add', 'update') OR coalesce(quantity > 0, false)) AS valid
FROM basket_events
"""
SQL["basket_fold"] = f"""
WITH {BASKET_CTE}
SELECT e.event_id AS seq, e.customer_id, e.product_id, e.op, e.quantity, coalesce(po.outcome, co.outcome) AS outcome
FROM basket_events e
LEFT JOIN po ON po.seq = e.event_id AND NOT po.opening
LEFT JOIN co ON co.seq = e.event_id
"""
SQL["basket_fold_basket"] = f"""
WITH {BASKET_CTE},
fin AS (SELECT customer_id, product_id, arg_max(flag, seq) AS f, max(seq) AS s FROM pe WHERE flag IS NOT NULL
        GROUP BY 1, 2),
lc AS (SELECT customer_id, max(seq) AS k FROM ev WHERE op = 'clear' GROUP BY 1),
q AS (SELECT customer_id, product_id, arg_max(quantity, seq) AS quantity FROM po
      WHERE opening OR (op IN ('add', 'update') AND outcome = 'OK') GROUP BY 1, 2)
SELECT fin.customer_id, fin.product_id, q.quantity
FROM fin LEFT JOIN lc ON lc.customer_id = fin.customer_id
LEFT JOIN q ON q.customer_id = fin.customer_id AND q.product_id = fin.product_id
WHERE fin.f = 1 AND (lc.k IS NULL OR fin.s > lc.k)
"""

# ---- view history and favourites
_VIEW_FKS = [("product_id", "products", "id"), ("customer_id", "customer_accounts", "id")]


def _views(target, days):
    """Views ``days`` later, judged against ``target``."""
    return w1(f"SELECT event_id AS seq, customer_id, product_id, CAST(ts + to_days(CAST({days} AS INTEGER)) AS DATE) AS date_viewed FROM view_events",
              target, ["customer_id", "product_id", "date_viewed"], _VIEW_FKS, "seq, customer_id, product_id, date_viewed")


_LATER = _views("product_view_history", "event_id % 3")
SQL["record_views"] = (f"SELECT seq, customer_id, product_id, date_viewed, "
                       f"CASE WHEN outcome = 'CONFLICT' THEN 'OK' ELSE outcome END AS outcome FROM ({_LATER}) x")
SQL["record_views_table"] = (f"SELECT customer_id, product_id, date_viewed FROM product_view_history "
                             f"UNION ALL SELECT customer_id, product_id, date_viewed FROM ({_LATER}) x WHERE outcome = 'OK'")
# The stream begins with an empty history and takes the views as they are.
SQL["stream_record_views"] = (f"SELECT customer_id, product_id, date_viewed FROM "
                              f"({_views('(SELECT * FROM product_view_history WHERE false)', '0')}) x WHERE outcome = 'OK'")
SQL["remove_views"] = w3(_EVENT_PAIRS, "product_view_history", ["customer_id", "product_id"],
                         "seq, customer_id, product_id")
SQL["favourite_set"] = w1(_EVENT_PAIRS, "customer_favourite_products", ["customer_id", "product_id"],
                          [("product_id", "products", "id"), ("customer_id", "customer_accounts", "id")],
                          "seq, customer_id, product_id")
SQL["favourite_remove"] = w3(_EVENT_PAIRS, "customer_favourite_products", ["customer_id", "product_id"],
                             "seq, customer_id, product_id")

# ---- reviews
SQL["review_intake"] = f"""
WITH {REVIEWS_CTE},
opening AS (SELECT customer_id, product_id, min(seq) AS id FROM subs GROUP BY ALL HAVING min(seq) % 2 = 1),
held AS (SELECT cand.*, EXISTS (SELECT 1 FROM opening o WHERE o.customer_id = cand.customer_id AND o.product_id = cand.product_id) AS taken FROM cand),
firsts2 AS (SELECT held.*, min(CASE WHEN fk_ok AND NOT taken THEN seq END) OVER (PARTITION BY customer_id, product_id) AS first_seq FROM held),
judged2 AS (SELECT seq, CASE WHEN taken OR coalesce(first_seq < seq, false) THEN 'CONFLICT' WHEN NOT fk_ok THEN 'FOREIGN_KEY_VIOLATION' ELSE 'OK' END AS outcome FROM firsts2)
SELECT s.seq, s.customer_id, s.product_id, CASE WHEN j.outcome = 'OK' THEN s.seq + (SELECT max(id) FROM opening) END AS id,
       coalesce(g.gate, j.outcome) AS outcome
FROM subs s JOIN gated g ON g.seq = s.seq LEFT JOIN judged2 j ON j.seq = s.seq
"""
SQL["product_reviews"] = f"WITH {REVIEWS_CTE} SELECT * FROM reviews"
SQL["review_updates"] = f"""
WITH {REVIEWS_CTE}
SELECT s.seq, s.seq - s.seq % 1000 + 100 AS id, s.customer_id,
       CASE WHEN NOT coalesce(s.rating + 1 >= 0 AND s.rating + 1 <= 10, false) THEN 'REJECTED'
            WHEN EXISTS (SELECT 1 FROM reviews r WHERE r.id = s.seq - s.seq % 1000 + 100
                         AND r.customer_id = s.customer_id) THEN 'OK'
            ELSE 'DOES_NOT_EXIST' END AS outcome
FROM subs s
"""
SQL["review_deletes"] = f"""
WITH {REVIEWS_CTE},
b AS (SELECT seq, seq - seq % 1000 + 200 AS id,
             CASE WHEN seq % 3 = 0 THEN customer_id + 1 ELSE customer_id END AS customer_id FROM subs),
f AS (SELECT b.*, EXISTS (SELECT 1 FROM reviews r WHERE r.id = b.id AND r.customer_id = b.customer_id) AS present
      FROM b),
g AS (SELECT f.*, min(CASE WHEN present THEN seq END) OVER (PARTITION BY id, customer_id) AS first_hit FROM f)
SELECT seq, id, customer_id, CASE WHEN present AND seq = first_hit THEN 'OK' ELSE 'DOES_NOT_EXIST' END AS outcome
FROM g
"""

# ---- answer ratings, questions, answers
_RATING_FKS = [("answer_id", "product_question_answers", "id"), ("customer_id", "customer_accounts", "id")]
SQL["answer_rating_add"] = w1(_VOTES, "product_question_answers_rating", ["answer_id", "customer_id"],
                              _RATING_FKS, "seq, answer_id, customer_id, helpful")
SQL["answer_rating_change"] = w2(_VOTES, "product_question_answers_rating", ["answer_id", "customer_id"],
                                 [], "seq, answer_id, customer_id, helpful")
SQL["answer_rating_remove"] = w3(_VOTES, "product_question_answers_rating", ["answer_id", "customer_id"],
                                 "seq, answer_id, customer_id")


def _conv(role, cols):
    return f"SELECT conv_id * 1000 + turn AS seq, {cols} FROM conversations WHERE role = '{role}'"


SQL["question_ask"] = w1(
    _conv("user", "conv_id % 2500 AS product_id, conv_id % 1600 AS asked_by, text AS question"),
    "product_questions", None, [("product_id", "products", "id"), ("asked_by", "customer_accounts", "id")],
    "seq, product_id, asked_by", "(SELECT coalesce(max(id), 0) FROM product_questions) + seq")
SQL["question_edit"] = w2(_conv("user", "conv_id + 1 AS id, text AS question"), "product_questions", ["id"],
                          [], "seq, id")
SQL["question_delete"] = w3(_conv("assistant", "conv_id * 2 AS id"), "product_questions", ["id"], "seq, id")
SQL["answer_insert"] = w1(
    _conv("assistant", "conv_id AS question_id, conv_id % 20 AS answered_by, text AS answer"),
    "product_question_answers", None,
    [("question_id", "product_questions", "id"), ("answered_by", "accounts", "id")],
    "seq, question_id, answered_by", "(SELECT coalesce(max(id), 0) FROM product_question_answers) + seq")

# ---- addresses and accounts
SQL["address_create"] = w1(
    "SELECT c_custkey AS seq, c_custkey AS customer_id, c_nationkey AS country_id FROM customer",
    "shipping_addresses", None, [("country_id", "shipping_countries", "id"), ("customer_id", "customer_accounts", "id")],
    "seq, customer_id, country_id", "(SELECT coalesce(max(id), 0) FROM shipping_addresses) + seq")
SQL["address_delete"] = w3(
    "SELECT c_custkey AS seq, c_custkey * 10 + c_custkey % 2 AS id, "
    "CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 ELSE c_custkey END AS customer_id FROM customer",
    "shipping_addresses", ["id", "customer_id"], "seq, id, customer_id")
SQL["default_address_set"] = w1(
    "SELECT id AS seq, customer_id, id AS shipping_address_id FROM shipping_addresses",
    "default_shipping_address", ["customer_id"],
    [("shipping_address_id", "shipping_addresses", "id"), ("customer_id", "customer_accounts", "id")],
    "seq, customer_id, shipping_address_id")
SQL["default_address_change"] = w2(
    "SELECT id AS seq, customer_id, id + 1 AS shipping_address_id FROM shipping_addresses",
    "default_shipping_address", ["customer_id"], [("shipping_address_id", "shipping_addresses", "id")],
    "seq, customer_id, shipping_address_id")
SQL["default_address_delete"] = w3("SELECT c_custkey AS seq, c_custkey % 1000 AS customer_id FROM customer",
                                   "default_shipping_address", ["customer_id"], "seq, customer_id")
SQL["account_intake"] = f"""
WITH b AS (SELECT c_custkey + 1 AS seq,
                  trim(CASE WHEN c_custkey % 9 = 0 THEN concat(lower(c_mktsegment), '.shop.example.com')
                            ELSE concat(' ', lower(c_mktsegment), '.', CAST(c_custkey % 50 AS VARCHAR),
                                        '@shop.example.com ') END) AS email,
                  'customer_accounts' AS account_table
           FROM customer),
v AS (SELECT b.*, regexp_matches(email, '{EMAIL_RE}') AS ok FROM b),
f AS (SELECT v.*, EXISTS (SELECT 1 FROM accounts a WHERE a.email = v.email) AS taken FROM v),
g AS (SELECT f.*, min(CASE WHEN ok AND NOT taken THEN seq END) OVER (PARTITION BY email) AS first_ok FROM f)
SELECT seq, email, account_table,
       CASE WHEN NOT ok THEN 'INVALID_EMAIL' WHEN taken THEN 'CONFLICT' WHEN seq = first_ok THEN 'OK'
            ELSE 'CONFLICT' END AS outcome
FROM g
"""

# ---- images
_IMG_NEW = """
SELECT page_id AS seq, page_id % 25 AS product_id,
       concat('upload-', CAST(page_id % 120 AS VARCHAR),
              CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.PNG'
                   ELSE '.gif' END) AS source
FROM pages
"""
_IMG_W1 = w1(f"SELECT * FROM ({_IMG_NEW}) n WHERE coalesce(regexp_extract(source, '^.+(\\.[^.]*)$', 1), '') "
             f"IN ('.png', '.jpeg', '.jpg')",
             "product_images", ["source"], [("product_id", "products", "id")], "seq",
             "(SELECT coalesce(max(id), 0) FROM product_images) + seq")
SQL["image_register"] = f"""
SELECT n.seq, n.product_id, n.source, w.id, coalesce(w.outcome, 'INVALID_FILE_TYPE') AS outcome
FROM ({_IMG_NEW}) n LEFT JOIN ({_IMG_W1}) w ON w.seq = n.seq
"""
SQL["image_drop"] = w3("SELECT page_id AS seq, page_id * 2 AS id FROM pages", "product_images", ["id"], "seq, id")
SQL["image_drop_returned"] = """
SELECT id, source, product_id FROM product_images WHERE id IN (SELECT page_id * 2 FROM pages)
"""
SQL["image_sort_order"] = f"""
WITH {SORT_REQ}
SELECT r.seq, r.product_id, CASE WHEN coalesce(v.ok, true) THEN 'OK' ELSE 'DOES_NOT_EXIST' END AS outcome
FROM r LEFT JOIN v ON v.seq = r.seq
"""
SQL["image_sort_order_table"] = f"""
WITH {SORT_REQ},
acc AS (SELECT items.* FROM items JOIN v ON v.seq = items.seq WHERE v.ok),
newest AS (SELECT id, arg_max(pos, seq * 100000 + pos) AS pos FROM acc GROUP BY id)
SELECT im.id, im.product_id, im.source, coalesce(n.pos, im.sort_position) AS sort_position
FROM product_images im LEFT JOIN newest n ON n.id = im.id
"""

# ---- streaming (S1 = V3 on an empty history, S2 = B2 in one micro-batch)
SQL["stream_basket_feed"] = SQL["basket_fold_basket"]
SQL["stream_basket_feed_messages"] = f"""
WITH {BASKET_CTE},
fin AS (SELECT customer_id, product_id, arg_max(flag, seq) AS f, max(seq) AS s FROM pe WHERE flag IS NOT NULL
        GROUP BY 1, 2),
lc AS (SELECT customer_id, max(seq) AS k FROM ev WHERE op = 'clear' GROUP BY 1),
q AS (SELECT customer_id, product_id, arg_max(quantity, seq) AS quantity FROM po
      WHERE opening OR (op IN ('add', 'update') AND outcome = 'OK') GROUP BY 1, 2),
basket AS (SELECT fin.customer_id, fin.product_id, q.quantity
           FROM fin LEFT JOIN lc ON lc.customer_id = fin.customer_id
           LEFT JOIN q ON q.customer_id = fin.customer_id AND q.product_id = fin.product_id
           WHERE fin.f = 1 AND (lc.k IS NULL OR fin.s > lc.k)),
touched AS (SELECT DISTINCT customer_id FROM po WHERE NOT opening AND op IN ('add', 'update', 'remove')
            AND outcome = 'OK'),
lists AS (SELECT customer_id, list_sort(list({{'productId': product_id, 'quantity': quantity}})) AS basket
          FROM basket GROUP BY customer_id)
SELECT t.customer_id,
       CAST(to_json({{'type': 'basketUpdate', 'basket': coalesce(l.basket, []), 'part': 1, 'parts': 1}}) AS VARCHAR) AS message
FROM touched t LEFT JOIN lists l ON l.customer_id = t.customer_id
"""

# ---- W5 with keys shared across groups: a sequential walk (recursive CTE),
# one group per step, carrying the set of taken keys.
SQL["assign_types"] = """
WITH RECURSIVE
g AS (SELECT row_number() OVER (ORDER BY p_partkey) AS rn, p_partkey AS seq,
             CAST(p_partkey % 150 + 1 AS BIGINT) AS pid,
             [CAST(p_size % 7 + 1 AS BIGINT), CAST((p_size + 3) % 7 + 1 AS BIGINT)] AS tids
      FROM part),
rws AS (SELECT g.rn, g.seq, r.i AS pos, g.pid, g.tids[r.i + 1] AS tid FROM g, range(2) r(i)),
rowsf AS (SELECT rws.*, CAST(pid AS VARCHAR) || ':' || CAST(tid AS VARCHAR) AS k,
                 EXISTS (SELECT 1 FROM base_products b WHERE b.id = rws.pid)
                 AND EXISTS (SELECT 1 FROM product_types t WHERE t.id = rws.tid) AS fk
          FROM rws),
grp AS (SELECT rn, seq, list(k ORDER BY pos) AS ks, list(fk ORDER BY pos) AS fks FROM rowsf GROUP BY rn, seq),
init AS (SELECT coalesce(list(CAST(product_id AS VARCHAR) || ':' || CAST(type_id AS VARCHAR)), []) AS taken
         FROM assigned_product_type),
walk(rn, taken, seq, outcome) AS (
  SELECT 0, (SELECT taken FROM init), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
  UNION ALL
  SELECT w.rn + 1,
         CASE WHEN j.o = 'OK' THEN list_concat(w.taken, grp.ks) ELSE w.taken END,
         grp.seq, j.o
  FROM walk w JOIN grp ON grp.rn = w.rn + 1,
  LATERAL (SELECT coalesce(list_filter(list_transform(range(1, len(grp.ks) + 1), lambda i:
                     CASE WHEN list_contains(w.taken, grp.ks[i]) OR list_contains(grp.ks[1:i - 1], grp.ks[i])
                          THEN 'CONFLICT'
                          WHEN NOT grp.fks[i] THEN 'FOREIGN_KEY_VIOLATION' END),
                   lambda x: x IS NOT NULL)[1], 'OK') AS o) j
)
SELECT seq, outcome FROM walk WHERE rn > 0
"""

