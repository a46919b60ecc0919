"""SQL oracles: independent formulations of the registered queries for a single-node engine."""

from __future__ import annotations

import re

from registry.fixtures import FIXTURES

_TS = "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
_DAY = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_NUM = r"[0-9]+(\.[0-9]+)?"


def ts(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{_TS}') THEN CAST(TRY_CAST({c} AS TIMESTAMP) AS DATE) END"


def any_day(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{_DAY}') THEN TRY_CAST({c} AS DATE) ELSE {ts(c)} END"


def digits(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '[0-9]+') THEN TRY_CAST({c} AS INTEGER) END"


def number(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '{_NUM}') THEN TRY_CAST(trim({c}) AS DECIMAL(10,2)) END"


def nonzero(c: str) -> str:
    return f"CASE WHEN TRY_CAST(trim({c}) AS DOUBLE) <> 0 THEN {number(c)} END"


def fraction(c: str) -> str:
    return rf"CASE WHEN regexp_full_match({c}, '[0-9]+\.[0-9]+') THEN TRY_CAST({c} AS DECIMAL(10,2)) END"


def dbl(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def _first(table: str, keys: str, rest: str, required: str) -> str:
    """One row per key by all other columns."""
    order = ", ".join(f"{c} ASC NULLS LAST" for c in rest.split())
    keep = " AND ".join(f"{c} IS NOT NULL" for c in required.split())
    part = ", ".join(keys.split())
    return (
        f"SELECT * FROM {table} WHERE {keep} "
        f"QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY {order}) = 1"
    )


def _latest(table: str, keys: str, rest: str) -> str:
    order = ", ".join(["ingested_at DESC NULLS LAST", *(f"{c} ASC NULLS LAST" for c in rest.split())])
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {', '.join(keys.split())} ORDER BY {order}) = 1"


CTES: dict[str, str] = dict(FIXTURES)

CTES["t_orders"] = f"""
SELECT * FROM (
  SELECT left(order_id, 50) AS order_id, left(customer_id, 50) AS customer_id,
    coalesce(left(order_status, 25), 'delivered') AS order_status,
    {", ".join(f"{ts(c)} AS {c}" for c in ("purchase_date", "order_approval_date", "delivered_carrier_date", "delivered_customer_date", "estimated_delivery_date"))}
  FROM ({_first("staging_orders", "order_id", "customer_id order_status purchase_date order_approval_date delivered_carrier_date delivered_customer_date estimated_delivery_date", "order_id customer_id purchase_date")})
) WHERE purchase_date IS NOT NULL"""

CTES["t_category"] = """
SELECT product_category, min(product_category_english) AS product_category_english
FROM (SELECT * FROM staging_product_category UNION ALL SELECT 'unknown', 'unknown')
WHERE product_category IS NOT NULL GROUP BY product_category"""

_SIZES = (
    "product_name_length", "product_description_length", "product_photos_qty", "product_weight_g",
    "product_length_cm", "product_height_cm", "product_width_cm",
)
CTES["t_products"] = f"""
SELECT left(product_id, 50) AS product_id, coalesce(product_category_name, 'unknown') AS product_category_name,
  {", ".join(f"{digits(c)} AS {c}" for c in _SIZES)}
FROM ({_first("staging_products", "product_id", "product_category_name " + " ".join(_SIZES), "product_id")})
WHERE coalesce(product_category_name, 'unknown') IN (SELECT product_category FROM t_category)"""

CTES["t_sellers"] = f"""
SELECT left(seller_id, 50) AS seller_id, {digits("zip_code")} AS zip_code, left(seller_city, 50) AS seller_city,
  left(seller_state, 3) AS seller_state
FROM ({_first("staging_sellers", "seller_id", "zip_code seller_city seller_state", "seller_id")})"""

CTES["t_items"] = f"""
SELECT * FROM (
  SELECT left(order_id, 50) AS order_id, TRY_CAST(item_id AS INTEGER) AS item_id, left(product_id, 50) AS product_id,
    left(seller_id, 50) AS seller_id, {ts("shipping_limit_date")} AS shipping_limit_date,
    {nonzero("price")} AS price, {fraction("freight_value")} AS freight_value
  FROM ({_first("staging_item_orders", "order_id item_id", "product_id seller_id shipping_limit_date price freight_value", "order_id item_id product_id seller_id shipping_limit_date price")})
) WHERE item_id IS NOT NULL AND shipping_limit_date IS NOT NULL AND price IS NOT NULL
  AND order_id IN (SELECT order_id FROM t_orders) AND seller_id IN (SELECT seller_id FROM t_sellers)
  AND product_id IN (SELECT product_id FROM t_products)"""

CTES["t_customers"] = f"""
SELECT left(customer_id, 50) AS customer_id, left(customer_unique_id, 50) AS customer_unique_id,
  {digits("zip_code")} AS zip_code, left(city, 50) AS city, left(customer_state, 3) AS customer_state
FROM ({_first("staging_customers", "customer_id", "customer_unique_id zip_code city customer_state", "customer_id customer_unique_id")})
WHERE customer_id IN (SELECT customer_id FROM t_orders)"""

CTES["unique_payments"] = _first(
    "staging_payments", "order_id payment_sequential", "payment_type num_installments payment_value", "order_id payment_value"
)
CTES["t_payments"] = f"""
SELECT * FROM (
  SELECT order_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY payment_sequential NULLS LAST) AS INTEGER) AS payment_sequential,
    coalesce(left(payment_type, 25), CASE WHEN count(*) OVER (PARTITION BY order_id) = 1 THEN 'credit_card' ELSE 'voucher' END) AS payment_type,
    CASE WHEN num_installments IS NULL THEN 1 ELSE TRY_CAST(num_installments AS INTEGER) END AS num_installments,
    {number("payment_value")} AS payment_value
  FROM unique_payments
) WHERE payment_value IS NOT NULL AND num_installments IS NOT NULL AND order_id IN (SELECT order_id FROM t_orders)"""

CTES["t_reviews"] = f"""
SELECT * FROM (
  SELECT review_id, order_id, CASE WHEN regexp_full_match(review_score, '[1-5]') THEN CAST(review_score AS INTEGER) END AS review_score,
    comment_title, comment_message, {ts("post_date")} AS post_date, {ts("answer_date")} AS answer_date
  FROM ({_first("staging_reviews", "review_id order_id", "review_score comment_title comment_message post_date answer_date", "review_id order_id review_score post_date")})
) WHERE review_score IS NOT NULL AND post_date IS NOT NULL AND order_id IN (SELECT order_id FROM t_orders)"""

# ---- encodings, history, items ------------------------------------------------------------

CTES["e_category"] = """
SELECT *, CAST(row_number() OVER (ORDER BY product_category) AS INTEGER) AS product_category_encoding FROM t_category"""
CTES["e_state"] = """
SELECT seller_state, CAST(row_number() OVER (ORDER BY seller_state ASC NULLS LAST) AS INTEGER) AS state_encoding
FROM (SELECT DISTINCT seller_state FROM t_sellers)"""
CTES["e_payment"] = """
SELECT payment_type, CAST(row_number() OVER (ORDER BY payment_type ASC NULLS LAST) AS INTEGER) AS payment_type_encoding
FROM (SELECT DISTINCT payment_type FROM t_payments)"""

CTES["h_base"] = """
SELECT 'offline' AS source_type, CAST(NULL AS VARCHAR) AS request_id, i.order_id, i.seller_id, o.purchase_date AS cutoff_date,
  CAST(sum(i.price) AS DECIMAL(12,2)) AS order_seller_price, CAST(sum(i.freight_value) AS DECIMAL(12,2)) AS order_seller_freight,
  CAST(count(*) AS INTEGER) AS num_order_items
FROM t_items i JOIN t_orders o USING (order_id) GROUP BY ALL"""


def to_date(base: str) -> str:
    prior = "(PARTITION BY seller_id ORDER BY cutoff_date, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
SELECT order_id, seller_id,
  coalesce({dbl(f"sum(order_seller_price) OVER {prior}")} / nullif(count(order_seller_price) OVER {prior}, 0), 0) AS avg_seller_price,
  coalesce({dbl(f"sum(order_seller_freight) OVER {prior}")} / nullif(count(order_seller_freight) OVER {prior}, 0), 0) AS avg_seller_freight,
  CAST(count(*) OVER {prior} AS BIGINT) AS seller_order_volume,
  CAST(coalesce(sum(num_order_items) OVER {prior}, 0) AS BIGINT) AS seller_item_volume
FROM {base}"""


CTES["h_to_date"] = to_date("h_base")

_JOINED = """i.order_id, i.item_id, i.product_id, i.shipping_limit_date, i.price, i.freight_value"""
CTES["j_items"] = f"""
SELECT {_JOINED}, p.product_category_name, c.product_category, c.product_category_english, c.product_category_encoding,
  i.seller_id, s.zip_code, s.seller_city, s.seller_state, e.state_encoding
FROM t_items i LEFT JOIN t_products p USING (product_id) LEFT JOIN e_category c ON c.product_category = p.product_category_name
LEFT JOIN t_sellers s ON s.seller_id = i.seller_id LEFT JOIN e_state e ON e.seller_state = s.seller_state"""


def rollup(source: str) -> str:
    share = f"{dbl('freight_value')} / nullif({dbl('price')}, 0)"
    return f"""
SELECT order_id, count(*) AS num_items_in_order, CAST(sum(freight_value) AS DECIMAL(12,2)) AS total_freight_value,
  CAST(sum(price) AS DECIMAL(12,2)) AS total_merch_value, CAST(sum(freight_value) + sum(price) AS DECIMAL(12,2)) AS total_order_value,
  {dbl("sum(price)")} / count(price) AS avg_price, coalesce(stddev_samp({dbl("price")}), 0) AS price_std, min(price) AS min_price,
  CAST(max(price) - min(price) AS DECIMAL(10,2)) AS price_range, {dbl("sum(freight_value)")} / nullif({dbl("sum(price)")}, 0) AS freight_price_ratio,
  max({share}) AS max_freight_ratio, min({share}) AS min_freight_ratio, max(shipping_limit_date) AS latest_shipping_limit_date,
  CAST(max(shipping_limit_date) - min(shipping_limit_date) AS INTEGER) AS shipping_window_days
FROM {source} GROUP BY order_id"""


def expensive(source: str) -> str:
    return f"""
SELECT order_id, product_id, seller_id, price, freight_value, product_category, product_category_encoding FROM {source}
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY price DESC NULLS FIRST, freight_value DESC NULLS FIRST, item_id) = 1"""


def categories(source: str) -> str:
    return f"""
SELECT order_id, product_category, product_category_encoding, count(*) AS cat_count,
  CAST(sum(price) AS DECIMAL(20,2)) AS total_price, CAST(sum(freight_value) AS DECIMAL(20,2)) AS total_freight
FROM {source} GROUP BY ALL"""


def ranked_categories(counts: str) -> str:
    return f"""
SELECT *, count(*) OVER w AS num_distinct_categories,
  {dbl("cat_count")} / {dbl("sum(cat_count) OVER w")} AS most_freq_cat_concentration,
  CAST(rank() OVER (PARTITION BY order_id ORDER BY cat_count DESC, total_price DESC NULLS FIRST, total_freight DESC NULLS FIRST) AS INTEGER) AS tiebreak_rank
FROM {counts} WINDOW w AS (PARTITION BY order_id)"""


def sellers(source: str) -> str:
    return f"""
SELECT *, count(seller_id) OVER w AS num_distinct_sellers, CASE WHEN count(seller_id) OVER w > 1 THEN 1 ELSE 0 END AS has_multiple_sellers
FROM (SELECT order_id, seller_id, zip_code, seller_city, seller_state, state_encoding,
    CAST(sum(price) + sum(freight_value) AS DECIMAL(12,2)) AS total_value, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS has_duplicate_sellers
  FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY order_id)"""


def item_features(source: str, roll: str, exp: str, cats: str, sell: str) -> str:
    return f"""
SELECT r.*, e.product_id AS most_exp_product_id, e.price AS most_exp_price, e.freight_value AS most_exp_freight,
  e.product_category AS most_exp_prod_category, e.product_category_encoding AS most_exp_encoded_category,
  c.product_category AS most_freq_category, c.product_category_encoding AS most_freq_encoded_category,
  c.num_distinct_categories, c.most_freq_cat_concentration,
  CASE WHEN st.n > 1 THEN 1 ELSE 0 END AS has_multiple_seller_states, st.n AS num_seller_states,
  s.seller_id AS val_seller_id, s.zip_code AS val_seller_zip, s.seller_city AS val_seller_city, s.seller_state AS val_seller_state,
  s.state_encoding AS val_seller_encoded_state, s.has_duplicate_sellers, s.has_multiple_sellers, s.num_distinct_sellers
FROM {roll} r JOIN {exp} e USING (order_id)
JOIN (SELECT order_id, count(DISTINCT seller_state) AS n FROM {source} GROUP BY order_id) st USING (order_id)
JOIN (SELECT * FROM {cats} QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY tiebreak_rank, product_category NULLS LAST) = 1) c USING (order_id)
JOIN (SELECT * FROM {sell} QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY total_value DESC NULLS FIRST, seller_id, zip_code NULLS FIRST, seller_city NULLS FIRST, seller_state NULLS FIRST) = 1) s USING (order_id)"""


CTES["i_rollup"] = rollup("j_items")
CTES["i_expensive"] = expensive("j_items")
CTES["i_categories"] = categories("j_items")
CTES["i_ranked"] = ranked_categories("i_categories")
CTES["i_sellers"] = sellers("j_items")
CTES["i_features"] = item_features("j_items", "i_rollup", "i_expensive", "i_ranked", "i_sellers")


def payments(source: str) -> str:
    return f"""
SELECT b.order_id, b.payment_type, e.payment_type_encoding AS most_freq_payment_type_encoded, b.n AS payment_type_count,
  b.total_installments, b.total_payment_value
FROM (SELECT order_id, payment_type, count(*) AS n,
    CAST(sum(sum(num_installments)) OVER (PARTITION BY order_id) AS BIGINT) AS total_installments,
    CAST(sum(sum(payment_value)) OVER (PARTITION BY order_id) AS DECIMAL(12,2)) AS total_payment_value
  FROM {source} GROUP BY order_id, payment_type
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY n DESC, payment_type NULLS LAST) = 1) b
LEFT JOIN e_payment e ON e.payment_type = b.payment_type"""


CTES["p_rollup"] = payments("t_payments")

CTES["r_asof"] = """
SELECT r.*, o.purchase_date AS t_pred_date FROM t_reviews r JOIN t_orders o ON o.order_id = r.order_id AND r.post_date <= o.purchase_date"""
_ANS = "(answer_date IS NOT NULL AND answer_date <= t_pred_date)"
_WAIT = f"CAST(least(coalesce(answer_date, t_pred_date), t_pred_date) - post_date AS INTEGER)"
CTES["r_rollup"] = f"""
SELECT order_id, {dbl("sum(review_score)")} / count(*) AS average_review_score,
  CAST(bool_or(comment_message IS NOT NULL) AS INTEGER) AS has_review_message, {dbl("count(comment_message)")} / count(*) AS has_message_proportion,
  CAST(count(*) > 1 AS INTEGER) AS has_multiple_reviews, count(*) AS num_reviews,
  CAST(max(post_date) - min(post_date) AS INTEGER) AS review_date_range, min(post_date) AS first_review_date, max(post_date) AS latest_review_date,
  CAST(bool_or({_ANS}) AS INTEGER) AS has_review_answer, {dbl(f"count(*) FILTER (WHERE {_ANS})")} / count(*) AS received_answer_proportion,
  max({_WAIT}) AS max_answer_time_days, min({_WAIT}) AS min_answer_time_days
FROM r_asof GROUP BY order_id"""

CTES["o_targets"] = """
SELECT o.order_id, o.customer_id, o.order_status, o.purchase_date, o.purchase_date AS t_pred_date,
  coalesce(o.order_approval_date, o.purchase_date) AS order_approval_date, o.delivered_carrier_date, o.delivered_customer_date,
  o.estimated_delivery_date, count(*) OVER (PARTITION BY c.customer_unique_id) AS total_purchases_by_customer,
  lead(o.purchase_date) OVER (PARTITION BY c.customer_unique_id ORDER BY o.purchase_date, o.order_id) AS second_purchase_date,
  c.customer_unique_id, c.zip_code AS customer_zip, c.city, c.customer_state
FROM t_orders o LEFT JOIN t_customers c USING (customer_id)"""

CALENDAR = """CAST(month(purchase_date) AS INTEGER) AS purchase_month, CAST(dayofweek(purchase_date) AS INTEGER) AS purchase_day_of_week,
  CASE WHEN dayofweek(purchase_date) IN (0, 6) THEN 1 ELSE 0 END AS purchased_on_weekend"""
LABELS = """CASE WHEN total_purchases_by_customer > 1 THEN 1 ELSE 0 END AS has_second_purchase,
  CAST(second_purchase_date - purchase_date AS INTEGER) AS days_until_second_purchase,
  CASE WHEN second_purchase_date IS NULL THEN 0 ELSE 1 END AS event_consistent"""
_CARRIER = "coalesce(delivered_carrier_date, latest_shipping_limit_date)"
DELIVERY = f"""CAST(delivered_customer_date - purchase_date AS INTEGER) AS total_order_duration_days,
  CASE WHEN delivered_customer_date > estimated_delivery_date THEN 1 ELSE 0 END AS late_delivery,
  CAST(estimated_delivery_date - delivered_customer_date AS INTEGER) AS early_delivery_days,
  CAST(delivered_customer_date - order_approval_date AS INTEGER) AS total_delivery_days,
  CAST(delivered_customer_date - {_CARRIER} AS INTEGER) AS carrier_to_customer_delivery_days,
  CAST(order_approval_date - purchase_date AS INTEGER) AS order_approval_days,
  CASE WHEN latest_shipping_limit_date < {_CARRIER} THEN 1 ELSE 0 END AS late_seller_dispatch,
  CAST(latest_shipping_limit_date - {_CARRIER} AS INTEGER) AS seller_dispatch_before_deadline_days,
  CAST(latest_shipping_limit_date - order_approval_date AS INTEGER) AS total_days_to_dispatch_last_item"""
_TIMING = {
    "premature_review": "CASE WHEN first_review_date < least(delivered_customer_date, estimated_delivery_date) AND delivered_customer_date IS NOT NULL AND estimated_delivery_date IS NOT NULL THEN 1 ELSE 0 END",
    "late_delivery_review": "CASE WHEN first_review_date < delivered_customer_date AND first_review_date > estimated_delivery_date THEN 1 ELSE 0 END",
    "delivery_to_first_review_days": "coalesce(CAST(first_review_date - delivered_customer_date AS INTEGER), -1)",
    "delivery_to_last_review_days": "coalesce(CAST(latest_review_date - delivered_customer_date AS INTEGER), -1)",
    "has_review_by_t_pred": "CASE WHEN num_reviews > 0 THEN 1 ELSE 0 END",
    "has_answer_by_t_pred": "coalesce(has_review_answer, 0)",
    **{
        c: f"coalesce({c}, 0)"
        for c in (
            "average_review_score", "has_review_message", "has_message_proportion", "has_multiple_reviews", "num_reviews",
            "has_review_answer", "received_answer_proportion",
        )
    },
    "max_answer_time_days": "coalesce(max_answer_time_days, -1)",
    "min_answer_time_days": "coalesce(min_answer_time_days, -1)",
}
TIMING = ", ".join(f"{v} AS {k}" for k, v in _TIMING.items())
SAME_STATE = "CASE WHEN has_multiple_seller_states = 0 AND customer_state = val_seller_state THEN 1 ELSE 0 END AS same_state_order"

CTES["first_orders"] = """
SELECT t.*, p.* EXCLUDE (order_id, payment_type), i.* EXCLUDE (order_id), h.* EXCLUDE (order_id, seller_id)
FROM o_targets t JOIN p_rollup p USING (order_id) JOIN i_features i USING (order_id)
JOIN h_to_date h ON h.order_id = t.order_id AND h.seller_id = i.val_seller_id
WHERE t.order_status = 'delivered' AND t.delivered_customer_date IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY t.customer_unique_id ORDER BY t.purchase_date, t.order_id) = 1"""
CTES["wide"] = f"""
SELECT f.* EXCLUDE (delivered_carrier_date, total_purchases_by_customer, second_purchase_date, city, customer_state),
  r.review_date_range, r.first_review_date, r.latest_review_date,
  {CALENDAR}, {LABELS}, {DELIVERY}, {TIMING}, {SAME_STATE}, {_CARRIER} AS delivered_carrier_date
FROM first_orders f LEFT JOIN r_rollup r USING (order_id)"""

# ---- requests -----------------------------------------------------------------------------

_ORDER_REST = "order_id customer_id customer_unique_id customer_zip customer_city customer_state order_status purchase_date"
CTES["typed_user_orders"] = f"""
SELECT left(request_id, 50) AS request_id, left(order_id, 50) AS order_id, left(customer_id, 50) AS customer_id,
  left(customer_unique_id, 50) AS customer_unique_id, {digits("customer_zip")} AS customer_zip, left(customer_city, 50) AS customer_city,
  left(customer_state, 3) AS customer_state, coalesce(left(order_status, 25), 'created') AS order_status,
  {any_day("purchase_date")} AS purchase_date, ingested_at
FROM staging_user_orders"""
CTES["complete_user_orders"] = "SELECT * FROM typed_user_orders WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in ("request_id " + _ORDER_REST).split()
)
CTES["u_orders"] = _latest("complete_user_orders", "request_id", _ORDER_REST)

# Requests that name the order of another request.
CTES["typed_shared_orders"] = CTES["typed_user_orders"].replace("staging_user_orders", "shared_orders")
CTES["complete_shared_orders"] = CTES["complete_user_orders"].replace("typed_user_orders", "typed_shared_orders")
CTES["u_shared"] = _latest("complete_shared_orders", "request_id", _ORDER_REST)
CTES["shared_owners"] = """
SELECT order_id, request_id AS owner_id FROM u_shared
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ingested_at NULLS LAST, request_id) = 1"""

_PAY_REST = "order_id payment_type num_installments payment_value"
CTES["typed_user_payments"] = f"""
SELECT left(request_id, 50) AS request_id, left(order_id, 50) AS order_id, {digits("payment_sequential")} AS payment_sequential,
  coalesce(left(payment_type, 25), 'credit_card') AS payment_type, {digits("num_installments")} AS num_installments,
  {number("payment_value")} AS payment_value, ingested_at
FROM staging_user_payments"""
CTES["complete_user_payments"] = (
    "SELECT * FROM typed_user_payments WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in ("request_id payment_sequential " + _PAY_REST).split())
    + " AND (request_id, order_id) IN (SELECT (request_id, order_id) FROM u_orders)"
)
CTES["u_payments"] = _latest("complete_user_payments", "request_id payment_sequential", _PAY_REST)

_ITEM_REST = (
    "order_id product_id seller_id shipping_limit_date price freight_value product_category_name seller_zip seller_city seller_state"
)
CTES["typed_user_items"] = f"""
SELECT left(request_id, 50) AS request_id, left(order_id, 50) AS order_id, {digits("item_id")} AS item_id,
  left(product_id, 50) AS product_id, left(seller_id, 50) AS seller_id, {any_day("shipping_limit_date")} AS shipping_limit_date,
  {number("price")} AS price, {number("freight_value")} AS freight_value, coalesce(product_category_name, 'unknown') AS product_category_name,
  {digits("seller_zip")} AS seller_zip, left(seller_city, 50) AS seller_city, left(seller_state, 3) AS seller_state, ingested_at
FROM staging_user_order_items"""
CTES["complete_user_items"] = (
    "SELECT * FROM typed_user_items WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in ("request_id item_id " + _ITEM_REST).split())
    + " AND (request_id, order_id) IN (SELECT (request_id, order_id) FROM u_orders)"
)
CTES["u_items"] = _latest("complete_user_items", "request_id item_id", _ITEM_REST)


def _bad(c: str, pattern: str, padded: bool = False) -> str:
    value = f"trim({c})" if padded else c
    return f"coalesce(NOT regexp_full_match({value}, '{pattern}'), true)"


def _bad_day(c: str) -> str:
    return f"coalesce(NOT regexp_full_match({c}, '{_DAY}( [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})?'), true)"


CTES["x_orders"] = f"""
SELECT s.*, (CASE WHEN request_id IS NULL THEN 'NULL request_id' WHEN order_id IS NULL THEN 'NULL order_id'
  WHEN customer_id IS NULL THEN 'NULL customer_id' WHEN customer_unique_id IS NULL THEN 'NULL customer_unique_id'
  WHEN {_bad("customer_zip", "[0-9]+")} THEN 'Invalid customer_zip' WHEN customer_city IS NULL THEN 'NULL customer_city'
  WHEN customer_state IS NULL THEN 'NULL customer_state' WHEN {_bad_day("purchase_date")} THEN 'Invalid purchase_date'
  ELSE 'Unknown validation error' END) || ' in table staging_user_orders' AS rejected_reason
FROM staging_user_orders s WHERE NOT EXISTS (FROM u_orders u WHERE u.request_id = s.request_id)"""
CTES["x_payments"] = f"""
SELECT s.*, CASE WHEN request_id = '' THEN 'Empty request_id in table staging_user_payments' WHEN order_id = '' THEN 'Empty order_id in table staging_user_payments'
  ELSE (CASE WHEN request_id IS NULL THEN 'NULL request_id' WHEN order_id IS NULL THEN 'NULL order_id'
    WHEN {_bad("payment_sequential", "[0-9]+")} THEN 'Invalid payment_sequential' WHEN {_bad("num_installments", "[0-9]+")} THEN 'Invalid num_installments'
    WHEN {_bad("payment_value", _NUM, True)} THEN 'Invalid payment_value' ELSE 'Unknown validation error' END)
    || ' in table staging_user_payments, payment_sequential ' || coalesce(payment_sequential, 'NULL') END AS rejected_reason
FROM staging_user_payments s WHERE NOT EXISTS (FROM u_payments u WHERE u.request_id = s.request_id AND u.order_id = s.order_id
  AND u.payment_sequential = {digits("s.payment_sequential")})"""
CTES["x_items"] = f"""
SELECT s.*, CASE WHEN request_id = '' THEN 'Empty request_id in table staging_user_order_items' WHEN order_id = '' THEN 'Empty order_id in table staging_user_order_items'
  ELSE (CASE WHEN request_id IS NULL THEN 'NULL request_id' WHEN order_id IS NULL THEN 'NULL order_id'
    WHEN {_bad("item_id", "[0-9]+")} THEN 'Invalid item_id' WHEN product_id IS NULL THEN 'NULL product_id' WHEN seller_id IS NULL THEN 'NULL seller_id'
    WHEN {_bad_day("shipping_limit_date")} THEN 'Invalid shipping_limit_date' WHEN {_bad("price", _NUM, True)} THEN 'Invalid price'
    WHEN {_bad("freight_value", _NUM, True)} THEN 'Invalid freight_value' WHEN {_bad("seller_zip", "[0-9]+")} THEN 'Invalid seller_zip'
    WHEN seller_city IS NULL THEN 'NULL seller_city' WHEN seller_state IS NULL THEN 'NULL seller_state' ELSE 'Unknown validation error' END)
    || ' in table staging_user_order_items, item_id ' || coalesce(item_id, 'NULL') END AS rejected_reason
FROM staging_user_order_items s WHERE NOT EXISTS (FROM u_items u WHERE u.request_id = s.request_id AND u.order_id = s.order_id
  AND u.item_id = {digits("s.item_id")})"""
CTES["x_all"] = """
SELECT request_id, 'rejected_user_orders' AS source_table, rejected_reason FROM x_orders
UNION ALL SELECT request_id, 'rejected_user_payments', rejected_reason FROM x_payments
UNION ALL SELECT request_id, 'rejected_user_order_items', rejected_reason FROM x_items"""
CTES["g_orders"] = "SELECT * FROM u_orders ANTI JOIN x_all USING (request_id)"
CTES["g_payments"] = "SELECT * FROM u_payments ANTI JOIN x_all USING (request_id)"
CTES["g_items"] = "SELECT * FROM u_items ANTI JOIN x_all USING (request_id)"

CTES["h_online"] = """
SELECT 'online' AS source_type, o.request_id, o.order_id, i.seller_id, o.purchase_date AS cutoff_date,
  CAST(sum(i.price) AS DECIMAL(12,2)) AS order_seller_price, CAST(sum(i.freight_value) AS DECIMAL(12,2)) AS order_seller_freight,
  CAST(count(*) AS INTEGER) AS num_order_items
FROM g_orders o JOIN g_items i ON i.request_id = o.request_id AND i.order_id = o.order_id GROUP BY ALL"""
CTES["h_merged"] = """
SELECT coalesce(b.source_type, n.source_type) AS source_type, coalesce(n.request_id, b.request_id) AS request_id, order_id, seller_id,
  CASE WHEN n.cutoff_date IS NULL THEN b.cutoff_date ELSE n.cutoff_date END AS cutoff_date,
  CASE WHEN n.cutoff_date IS NULL THEN b.order_seller_price ELSE n.order_seller_price END AS order_seller_price,
  CASE WHEN n.cutoff_date IS NULL THEN b.order_seller_freight ELSE n.order_seller_freight END AS order_seller_freight,
  CASE WHEN n.cutoff_date IS NULL THEN b.num_order_items ELSE n.num_order_items END AS num_order_items
FROM h_base b FULL JOIN h_online n USING (order_id, seller_id)"""
CTES["h_merged_to_date"] = to_date("h_merged")

CTES["k_items"] = """
SELECT i.request_id AS order_id, i.item_id, i.product_id, i.shipping_limit_date, i.price, i.freight_value, i.product_category_name,
  c.product_category, c.product_category_english, c.product_category_encoding, i.seller_id, i.seller_zip AS zip_code, i.seller_city,
  i.seller_state, e.state_encoding
FROM g_items i LEFT JOIN e_category c ON c.product_category = i.product_category_name LEFT JOIN e_state e ON e.seller_state = i.seller_state"""
CTES["k_rollup"] = rollup("k_items")
CTES["k_expensive"] = expensive("k_items")
CTES["k_categories"] = categories("k_items")
CTES["k_ranked"] = ranked_categories("k_categories")
CTES["k_sellers"] = sellers("k_items")
CTES["k_features"] = item_features("k_items", "k_rollup", "k_expensive", "k_ranked", "k_sellers")
CTES["k_payments_in"] = "SELECT request_id AS order_id, payment_type, num_installments, payment_value FROM g_payments"
CTES["k_payments"] = payments("k_payments_in")
CTES["k_rows"] = f"""
SELECT o.request_id, o.order_id, o.customer_id, o.order_status, o.purchase_date, o.purchase_date AS t_pred_date, o.customer_unique_id,
  o.customer_zip, {CALENDAR.replace("purchase_date", "o.purchase_date")}, p.* EXCLUDE (order_id, payment_type), i.* EXCLUDE (order_id),
  h.* EXCLUDE (order_id, seller_id), o.ingested_at
FROM g_orders o JOIN k_payments p ON p.order_id = o.request_id JOIN k_features i ON i.order_id = o.request_id
JOIN h_merged_to_date h ON h.order_id = o.order_id AND h.seller_id = i.val_seller_id"""

# ---- survival -----------------------------------------------------------------------------

CTES["s_rows"] = """
SELECT r.id, r.t_pred_date, r.n_orders, r.has_second_purchase, CAST(r.risk_score AS BIGINT) AS risk_score,
  coalesce(CAST(nx.d - r.t_pred_date AS INTEGER),
    CAST((SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - r.t_pred_date AS INTEGER)) AS days_until_second_purchase
FROM survival_rows r LEFT JOIN (
  SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS d FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 2) nx USING (id)"""


def compose(sql: str) -> str:
    """The statement with the CTEs it needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in CTES if n in needed)
    return f"WITH {ctes} {sql.strip()}" if ctes else sql.strip()
