"""Final statements of the SQL oracles, one per checkable query."""

from __future__ import annotations

from registry.oracle import (
    _ITEM_REST, _ORDER_REST, _PAY_REST, CALENDAR, CTES, DELIVERY, LABELS, SAME_STATE, TIMING, any_day, compose, digits, fraction, nonzero, number, ts,
)

# Columns of the purchase-time view, and those no model is trained on.
PURCHASE_TIME_COLUMNS = """
order_id customer_id order_status purchase_date t_pred_date has_second_purchase days_until_second_purchase
customer_unique_id customer_zip purchase_month purchase_day_of_week purchased_on_weekend
most_freq_payment_type_encoded payment_type_count total_installments total_payment_value num_items_in_order
total_freight_value total_merch_value total_order_value avg_price price_std min_price price_range freight_price_ratio
max_freight_ratio min_freight_ratio has_multiple_seller_states num_seller_states latest_shipping_limit_date
shipping_window_days most_exp_product_id most_exp_price most_exp_freight most_exp_prod_category
most_exp_encoded_category most_freq_category most_freq_encoded_category num_distinct_categories
most_freq_cat_concentration val_seller_id val_seller_zip val_seller_city val_seller_state val_seller_encoded_state
has_duplicate_sellers has_multiple_sellers num_distinct_sellers avg_seller_price avg_seller_freight
seller_order_volume seller_item_volume
""".split()
UNTRAINED_COLUMNS = """
order_id customer_id order_status purchase_date t_pred_date has_second_purchase days_until_second_purchase
customer_unique_id customer_zip latest_shipping_limit_date most_exp_product_id most_exp_prod_category
most_freq_category val_seller_id val_seller_zip val_seller_city val_seller_state total_order_value request_id
ingested_at
""".split()

_ORDER_DATES = "purchase_date order_approval_date delivered_carrier_date delivered_customer_date estimated_delivery_date"
_ROLLUP_MONEY = "total_freight_value total_merch_value total_order_value min_price price_range"
_EXP_MONEY = "most_exp_price most_exp_freight"
_STD = {"price_std": "round(price_std, 6)"}


def out(source: str, dates: str = "", money: str = "", stamps: str = "", drop: str = "", where: str = "", **exact: str) -> str:
    """All columns of a source with engine-neutral types."""
    swaps = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    swaps += [f"CAST({c} AS DOUBLE) AS {c}" for c in money.split()]
    swaps += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in stamps.split()]
    swaps += [f"{v} AS {c}" for c, v in exact.items()]
    exclude = f" EXCLUDE ({', '.join(drop.split())})" if drop else ""
    replace = f" REPLACE ({', '.join(swaps)})" if swaps else ""
    return f"SELECT *{exclude}{replace} FROM {source}" + (f" WHERE {where}" if where else "")


def day(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR)"


_WIDE_DATES = (
    "purchase_date t_pred_date order_approval_date delivered_carrier_date delivered_customer_date estimated_delivery_date "
    "latest_shipping_limit_date first_review_date latest_review_date"
)
_VIEW_DATES = "purchase_date t_pred_date latest_shipping_limit_date"
_VIEW_MONEY = f"total_payment_value {_ROLLUP_MONEY} {_EXP_MONEY}"
_VIEW = f"(SELECT {', '.join(PURCHASE_TIME_COLUMNS)} FROM wide)"
_REQUEST_STAMP = "ingested_at"

SQL: dict[str, str] = {}

# ---- sources and sinks
SQL["scan_csv_staging"] = """
SELECT order_id, customer_id, order_status, purchase_date AS order_purchase_timestamp, order_approval_date AS order_approved_at,
  delivered_carrier_date AS order_delivered_carrier_date, delivered_customer_date AS order_delivered_customer_date,
  estimated_delivery_date AS order_estimated_delivery_date FROM staging_orders"""
SQL["align_headers"] = "SELECT * FROM staging_reviews"
SQL["append_and_rebuild"] = out("t_orders", _ORDER_DATES)
SQL["param_query"] = out(
    "staging_user_order_items", stamps="ingested_at", where="seller_state = 'S3' AND ingested_at >= TIMESTAMP '2001-03-01'"
)
SQL["paged_scan"] = out("(SELECT * FROM t_orders ORDER BY order_id LIMIT 500 OFFSET 2000)", _ORDER_DATES)
SQL["explode_requests"] = out("staging_user_order_items", stamps="ingested_at", where="request_id IS NOT NULL")
SQL["explode_request_orders"] = out("staging_user_orders", stamps="ingested_at", where="request_id IS NOT NULL")
SQL["explode_request_payments"] = out("staging_user_payments", stamps="ingested_at", where="request_id IS NOT NULL")
SQL["sanitize_blanks"] = """
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN ' ' || c_mktsegment END AS segment FROM customer"""
SQL["option_lists"] = """
SELECT 'state' AS option_list, seller_state AS option_value FROM e_state
UNION ALL SELECT 'product_category', product_category FROM e_category
UNION ALL SELECT 'payment_type', payment_type FROM e_payment"""

# ---- casts, filters and dedupe
SQL["cast_ts_date"] = (
    "SELECT customer_id, " + ", ".join(f"{day(ts(c))} AS {c}" for c in _ORDER_DATES.split()) + " FROM staging_orders"
)
SQL["cast_date_two_formats"] = f"""
SELECT request_id, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at, {day(any_day("purchase_date"))} AS purchase_date
FROM staging_user_orders"""
SQL["cast_int_guarded"] = f"""
SELECT product_id, {digits("product_photos_qty")} AS product_photos_qty, {digits("product_weight_g")} AS product_weight_g
FROM staging_products"""
for _name, _column, _value in (
    ("cast_decimal_guarded", "price", number("price")),
    ("cast_price_nonzero", "price", nonzero("price")),
    ("cast_freight_strict", "freight_value", fraction("freight_value")),
):
    SQL[_name] = f"SELECT order_id, item_id, product_id, CAST({_value} AS DOUBLE) AS {_column} FROM staging_item_orders"
SQL["varchar_truncate"] = "SELECT p_partkey, p_name[1:6] AS name, p_type[1:3] AS type FROM part"
SQL["payment_type_default"] = """
SELECT * REPLACE (CASE WHEN payment_type IS NOT NULL THEN payment_type WHEN count(*) OVER (PARTITION BY order_id) > 1 THEN 'voucher'
  ELSE 'credit_card' END AS payment_type) FROM unique_payments"""


def _item_reason() -> str:
    stamp = "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
    return f"""
SELECT * FROM (SELECT *, CASE WHEN order_id IS NULL THEN 'NULL order_id' WHEN item_id IS NULL THEN 'NULL item_id'
  WHEN product_id IS NULL THEN 'NULL product_id' WHEN shipping_limit_date IS NULL THEN 'NULL shipping_date'
  WHEN seller_id IS NULL THEN 'NULL seller_id'
  WHEN NOT regexp_full_match(shipping_limit_date, '{stamp}') THEN 'Incorrect shipping_limit_date format'
  WHEN NOT regexp_full_match(trim(price), '[0-9]+(\\.[0-9]+)?') THEN 'Incorrect price format'
  WHEN order_id NOT IN (SELECT order_id FROM t_orders) THEN 'order_id not in final_orders'
  WHEN seller_id NOT IN (SELECT seller_id FROM t_sellers) THEN 'seller_id not in final_sellers'
  WHEN product_id NOT IN (SELECT product_id FROM t_products) THEN 'product_id not in final_products' END AS rejected_reason
FROM staging_item_orders) WHERE rejected_reason IS NOT NULL"""


SQL["reject_reason_first_match"] = f"SELECT rejected_reason, count(*) AS rejected_rows FROM ({_item_reason()}) GROUP BY 1"
SQL["dedupe_first_total_order"] = """
SELECT * FROM staging_item_orders QUALIFY row_number() OVER (PARTITION BY order_id, item_id ORDER BY product_id NULLS LAST,
  seller_id NULLS LAST, shipping_limit_date NULLS LAST, price NULLS LAST, freight_value NULLS LAST) = 1"""
SQL["dedupe_latest_wins"] = out(
    """(SELECT * FROM staging_user_order_items QUALIFY row_number() OVER (PARTITION BY request_id, item_id
  ORDER BY ingested_at DESC NULLS LAST, order_id NULLS LAST, product_id NULLS LAST, seller_id NULLS LAST, shipping_limit_date NULLS LAST,
  price NULLS LAST, freight_value NULLS LAST, product_category_name NULLS LAST, seller_zip NULLS LAST, seller_city NULLS LAST,
  seller_state NULLS LAST) = 1)""",
    stamps="ingested_at",
)

# ---- cleaning and rejects
SQL["clean_orders"] = out("t_orders", _ORDER_DATES)
SQL["clean_product_category"] = "SELECT * FROM t_category"
SQL["clean_products"] = "SELECT * FROM t_products"
SQL["clean_sellers"] = "SELECT * FROM t_sellers"
SQL["clean_item_orders"] = out("t_items", "shipping_limit_date", "price freight_value")
SQL["clean_customers"] = "SELECT * FROM t_customers"
SQL["clean_payments"] = out("t_payments", money="payment_value")
SQL["clean_reviews"] = out("t_reviews", "post_date answer_date")
_STAMP = "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
_ORDER_REASON = f"""CASE WHEN order_id IS NULL THEN 'NULL order_id' WHEN customer_id IS NULL THEN 'NULL customer_id'
  WHEN purchase_date IS NULL THEN 'NULL purchase_date' WHEN NOT regexp_full_match(purchase_date, '{_STAMP}') THEN 'Incorrect purchase_date format' END"""
SQL["rejected_orders"] = f"SELECT * FROM (SELECT *, {_ORDER_REASON} AS rejected_reason FROM staging_orders) WHERE rejected_reason IS NOT NULL"
SQL["rejected_sellers"] = "SELECT *, 'seller_id is NULL' AS rejected_reason FROM staging_sellers WHERE seller_id IS NULL"
SQL["rejected_product_category"] = """
SELECT *, 'product_category is NULL' AS rejected_reason FROM staging_product_category WHERE product_category IS NULL"""
SQL["rejected_products"] = """
SELECT *, CASE WHEN product_id IS NULL THEN 'NULL product_id' ELSE 'product_category_name not in parent' END AS rejected_reason
FROM staging_products WHERE product_id IS NULL OR product_category_name NOT IN (SELECT product_category FROM t_category)"""
SQL["rejected_item_orders"] = _item_reason()
SQL["rejected_customers"] = """
SELECT *, CASE WHEN customer_id IS NULL THEN 'NULL customer_id' WHEN customer_unique_id IS NULL THEN 'NULL customer_unique_id' END AS rejected_reason
FROM staging_customers WHERE customer_id IS NULL OR customer_unique_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM t_orders)"""
SQL["rejected_payments"] = """
SELECT *, CASE WHEN order_id IS NULL THEN 'NULL order_id'
  WHEN NOT regexp_full_match(trim(payment_value), '[0-9]+(\\.[0-9]+)?') THEN 'Incorrect payment_value format' END AS rejected_reason
FROM staging_payments WHERE order_id IS NULL OR payment_value IS NULL OR order_id NOT IN (SELECT order_id FROM t_orders)
  OR NOT regexp_full_match(trim(payment_value), '[0-9]+(\\.[0-9]+)?')"""
SQL["rejected_reviews"] = f"""
SELECT * FROM (SELECT *, CASE WHEN review_id IS NULL THEN 'NULL review_id' WHEN order_id IS NULL THEN 'NULL order_id'
  WHEN review_score IS NULL THEN 'NULL review_score' WHEN post_date IS NULL THEN 'NULL post_date'
  WHEN NOT regexp_full_match(review_score, '[1-5]') THEN 'Incorrect review_Score format'
  WHEN NOT regexp_full_match(post_date, '{_STAMP}') THEN 'Incorrect post_date format'
  WHEN order_id NOT IN (SELECT order_id FROM t_orders) THEN 'order_id not in parent' END AS rejected_reason
FROM staging_reviews) WHERE rejected_reason IS NOT NULL"""
SQL["audit_orders"] = f"""
SELECT *, 1 AS copies, coalesce({_ORDER_REASON}, 'purchase_date not in the calendar') AS rejected_reason
FROM staging_orders s WHERE NOT EXISTS (FROM t_orders t WHERE t.order_id = s.order_id)"""


SQL["audit_totals"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM staging_{t}) - (SELECT count(*) FROM {c}) AS dropped_rows, "
    f"(SELECT count(*) FROM {c}) AS typed_rows"
    for t, c in (
        ("orders", "t_orders"), ("sellers", "t_sellers"), ("products", "t_products"), ("item_orders", "t_items"),
        ("customers", "t_customers"), ("payments", "t_payments"), ("reviews", "t_reviews"),
        ("product_category", "(SELECT * FROM t_category WHERE product_category <> 'unknown')"),
    )
)


def _unique(table: str, source: str, keys: str) -> str:
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"""SELECT '{table}' AS table_name, 'unique({keys})' AS check_name,
  (SELECT count(*) - count(DISTINCT ({keys})) FROM {source} WHERE {known}) AS violations"""


def _not_null(table: str, source: str, column: str) -> str:
    return f"SELECT '{table}', 'not null({column})', (SELECT count(*) FROM {source} WHERE {column} IS NULL)"


def _references(table: str, source: str, column: str, parent: str, key: str) -> str:
    return f"""SELECT '{table}', 'references({column})', (SELECT count(*) FROM {source} t WHERE {column} IS NOT NULL
  AND NOT EXISTS (FROM {parent} p WHERE p.{key} = t.{column}))"""


def _checks() -> str:
    def unique(table: str, keys: str) -> str:
        return _unique(table, f"staging_{table}", keys)

    def not_null(table: str, column: str) -> str:
        return _not_null(table, f"staging_{table}", column)

    def references(table: str, column: str, parent: str, key: str) -> str:
        return _references(table, f"staging_{table}", column, f"staging_{parent}", key)

    return " UNION ALL ".join(
        [
            unique("orders", "order_id"), unique("orders", "customer_id"), unique("product_category", "product_category"),
            unique("products", "product_id"), unique("sellers", "seller_id"), unique("item_orders", "order_id, item_id"),
            unique("customers", "customer_id"), unique("payments", "order_id, payment_sequential"),
            unique("reviews", "review_id, order_id"),
            *(not_null("orders", c) for c in ("order_id", "customer_id", "purchase_date")),
            not_null("product_category", "product_category"), not_null("sellers", "seller_id"),
            *(not_null("products", c) for c in ("product_id", "product_category_name")),
            *(not_null("item_orders", c) for c in ("order_id", "item_id", "product_id", "seller_id", "shipping_limit_date", "price")),
            *(not_null("customers", c) for c in ("customer_id", "customer_unique_id")),
            *(not_null("payments", c) for c in ("order_id", "payment_sequential", "payment_value")),
            *(not_null("reviews", c) for c in ("review_id", "order_id", "review_score", "post_date")),
            references("products", "product_category_name", "product_category", "product_category"),
            references("item_orders", "order_id", "orders", "order_id"),
            references("item_orders", "product_id", "products", "product_id"),
            references("item_orders", "seller_id", "sellers", "seller_id"),
            references("customers", "customer_id", "orders", "customer_id"),
            references("payments", "order_id", "orders", "order_id"), references("reviews", "order_id", "orders", "order_id"),
        ]
    )


def _online_checks() -> str:
    tables = {"user_orders": "staging_user_orders", "user_order_items": "staging_user_order_items",
              "user_payments": "staging_user_payments", "user_features": "k_rows"}
    keys = {"user_orders": ("request_id", "order_id"), "user_order_items": ("request_id, item_id",),
            "user_payments": ("request_id, payment_sequential",), "user_features": ("request_id", "order_id")}
    required = {
        "user_orders": "request_id " + _ORDER_REST, "user_order_items": "request_id item_id " + _ITEM_REST,
        "user_payments": "request_id payment_sequential " + _PAY_REST, "user_features": " ".join(c for c in _K_COLUMNS if c != "ingested_at"),
    }
    parts = [_unique(t, tables[t], k) for t in tables for k in keys[t]]
    parts += [_not_null(t, tables[t], c) for t in tables for c in (*required[t].split(), "ingested_at")]
    parts += [
        _references(t, tables[t], c, "staging_user_orders", c)
        for t in ("user_order_items", "user_payments") for c in ("request_id", "order_id")
    ]
    return " UNION ALL ".join(parts)


SQL["constraint_violations"] = _checks()

# ---- joins
SQL["semi_join_parents"] = "SELECT s.* FROM staging_item_orders s WHERE EXISTS (FROM t_orders o WHERE o.order_id = s.order_id)"
SQL["anti_join_not_in"] = "SELECT * FROM staging_item_orders WHERE product_id NOT IN (SELECT product_id FROM t_products)"
SQL["anti_join_left_null"] = """
SELECT s.* REPLACE (strftime(s.ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at) FROM staging_user_orders s
LEFT JOIN u_orders u ON u.request_id = s.request_id WHERE u.request_id IS NULL"""
SQL["order_items_joined"] = out("j_items", "shipping_limit_date", "price freight_value")
SQL["reviews_asof"] = out("r_asof", "post_date answer_date t_pred_date")
_TARGET_DATES = _ORDER_DATES + " t_pred_date second_purchase_date"
SQL["order_targets"] = out("o_targets", _TARGET_DATES)

# ---- encodings, rollups and ranks
SQL["encode_category"] = "SELECT * FROM e_category"
SQL["encode_state"] = "SELECT * FROM e_state"
SQL["encode_payment_type"] = "SELECT * FROM e_payment"
SQL["seller_history_base"] = out("h_base", "cutoff_date", "order_seller_price order_seller_freight")
SQL["seller_history_to_date"] = "SELECT * FROM h_to_date"
SQL["seller_history_before_day"] = """
SELECT a.order_id, a.seller_id, coalesce(CAST(sum(b.order_seller_price) AS DOUBLE) / nullif(count(b.order_seller_price), 0), 0) AS avg_seller_price,
  coalesce(CAST(sum(b.order_seller_freight) AS DOUBLE) / nullif(count(b.order_seller_freight), 0), 0) AS avg_seller_freight,
  count(b.order_id) AS seller_order_volume, CAST(coalesce(sum(b.num_order_items), 0) AS BIGINT) AS seller_item_volume
FROM h_base a LEFT JOIN h_base b ON b.seller_id = a.seller_id AND b.cutoff_date < a.cutoff_date GROUP BY a.order_id, a.seller_id"""
SQL["payment_rollup"] = out("p_rollup", money="total_payment_value")
SQL["review_rollup"] = out("r_rollup", "first_review_date latest_review_date")
SQL["distinct_seller_states"] = """
SELECT order_id, count(DISTINCT seller_state) AS num_seller_states, CASE WHEN count(DISTINCT seller_state) > 1 THEN 1 ELSE 0 END AS has_multiple_seller_states
FROM j_items GROUP BY order_id"""
SQL["category_counts"] = out("i_categories", money="total_price total_freight")
SQL["seller_value_per_order"] = out("i_sellers", money="total_value")
SQL["order_rollup"] = out("i_rollup", "latest_shipping_limit_date", _ROLLUP_MONEY, **_STD)
SQL["most_expensive_item"] = out("i_expensive", money="price freight_value")
SQL["freight_ratio_bounds"] = "SELECT order_id, max_freight_ratio, min_freight_ratio FROM i_rollup"
SQL["ranked_category"] = out("i_ranked", money="total_price total_freight")
SQL["ranked_seller"] = """
SELECT * REPLACE (CAST(total_value AS DOUBLE) AS total_value),
  CAST(rank() OVER (PARTITION BY order_id ORDER BY total_value DESC NULLS FIRST) AS INTEGER) AS tiebreak_rank FROM i_sellers"""
SQL["item_order_features"] = out("i_features", "latest_shipping_limit_date", f"{_ROLLUP_MONEY} {_EXP_MONEY}", **_STD)

# ---- feature tables
SQL["calendar_features"] = f"SELECT order_id, {CALENDAR} FROM t_orders"
SQL["survival_labels"] = f"SELECT order_id, {LABELS} FROM o_targets"
SQL["delivery_features"] = f"""
SELECT order_id, {DELIVERY} FROM o_targets JOIN (SELECT order_id, max(shipping_limit_date) AS latest_shipping_limit_date
  FROM t_items GROUP BY order_id) USING (order_id)"""
SQL["review_timing_features"] = f"SELECT order_id, {TIMING} FROM o_targets LEFT JOIN r_rollup USING (order_id)"
SQL["same_state_order"] = f"SELECT order_id, val_seller_id, {SAME_STATE} FROM o_targets JOIN i_features USING (order_id)"
SQL["first_order_per_customer"] = out(
    "(SELECT * FROM o_targets QUALIFY row_number() OVER (PARTITION BY customer_unique_id ORDER BY purchase_date, order_id) = 1)",
    _TARGET_DATES,
)
SQL["customer_features_wide"] = out("wide", _WIDE_DATES, _VIEW_MONEY, **_STD)
SQL["purchase_time_view"] = out(_VIEW, _VIEW_DATES, _VIEW_MONEY, **_STD)
_KEPT = [c for c in PURCHASE_TIME_COLUMNS if c not in UNTRAINED_COLUMNS]
_KEPT_MONEY = " ".join(c for c in _VIEW_MONEY.split() if c in _KEPT)
SQL["trainable_projection"] = out(f"(SELECT {', '.join(_KEPT)} FROM wide)", money=_KEPT_MONEY, **_STD)
SQL["align_to_model"] = """
SELECT order_id, avg_price, CAST(num_items_in_order AS DOUBLE) AS num_items_in_order, CAST(0 AS DOUBLE) AS absent_feature,
  CAST(seller_order_volume AS DOUBLE) AS seller_order_volume, CAST(val_seller_encoded_state AS DOUBLE) AS val_seller_encoded_state FROM wide"""

# ---- requests
SQL["online_orders_valid"] = out("u_orders", "purchase_date", stamps=_REQUEST_STAMP)
SQL["online_payments_valid"] = out("u_payments", money="payment_value", stamps=_REQUEST_STAMP)
SQL["online_items_valid"] = out("u_items", "shipping_limit_date", "price freight_value", _REQUEST_STAMP)
for _kind in ("orders", "payments", "items"):
    SQL[f"online_{_kind}_rejected"] = out(f"x_{_kind}", stamps=_REQUEST_STAMP)
SQL["rejected_gate"] = """
SELECT i.request_id, count(*) FILTER (WHERE x.source_table = 'rejected_user_orders') AS rejected_orders_count,
  count(*) FILTER (WHERE x.source_table = 'rejected_user_payments') AS rejected_payments_count,
  count(*) FILTER (WHERE x.source_table = 'rejected_user_order_items') AS rejected_items_count,
  count(x.source_table) AS total_rejected_rows, CAST(count(x.source_table) > 0 AS INTEGER) AS any_rejected_rows
FROM (SELECT request_id FROM staging_user_orders UNION SELECT request_id FROM x_all) i
LEFT JOIN x_all x ON x.request_id IS NOT DISTINCT FROM i.request_id GROUP BY i.request_id"""
SQL["rejected_reasons"] = "SELECT request_id, rejected_reason FROM x_all WHERE rejected_reason IS NOT NULL"
SQL["online_order_conflicts"] = """
SELECT request_id, order_id, owner_id, 'order_id belongs to another request' AS rejected_reason
FROM u_shared JOIN shared_owners USING (order_id) WHERE owner_id <> request_id"""
SQL["history_upsert"] = out("h_merged", "cutoff_date", "order_seller_price order_seller_freight")
_K_COLUMNS = ["request_id", *[c for c in PURCHASE_TIME_COLUMNS if c not in ("has_second_purchase", "days_until_second_purchase")], "ingested_at"]
_K = f"(SELECT {', '.join(_K_COLUMNS)} FROM k_rows)"
_REQUIRED = [c for c in _K_COLUMNS if c not in (
    "request_id", "order_id", "customer_id", "order_status", "purchase_date", "t_pred_date", "customer_unique_id", "customer_zip",
    "purchase_month", "purchase_day_of_week", "purchased_on_weekend", "ingested_at")]
_ENCODED = ("most_freq_payment_type_encoded", "most_exp_encoded_category", "most_freq_encoded_category", "val_seller_encoded_state")
SQL["online_features"] = out(
    _K, _VIEW_DATES, _VIEW_MONEY, _REQUEST_STAMP, where=" AND ".join(f"{c} IS NOT NULL" for c in _REQUIRED), **_STD
)
CTES["k_refused"] = "SELECT * FROM (SELECT request_id, CASE " + " ".join(
    f"WHEN {c} IS NULL THEN '{'unseen' if c in _ENCODED else 'NULL'} {c}'" for c in _REQUIRED
) + " END AS rejected_reason FROM k_rows) WHERE rejected_reason IS NOT NULL"
SQL["online_features_refused"] = "SELECT * FROM k_refused"
SQL["online_constraint_violations"] = _online_checks()
_COMPARED = [c for c in _K_COLUMNS if c not in ("request_id", "order_id", "ingested_at")]


def _differs(c: str) -> str:
    a, b = (f"round({s}.{c}, 6)" if c == "price_std" else f"{s}.{c}" for s in ("w", "k"))
    return f"SELECT '{c}' AS feature, count(*) AS compared_orders, count(*) FILTER (WHERE {a} IS DISTINCT FROM {b}) AS differing_orders FROM wide w JOIN k_rows k USING (order_id)"


SQL["train_serve_parity"] = " UNION ALL ".join(_differs(c) for c in _COMPARED)

# ---- sorts, upserts, retention
SQL["sort_null_order"] = out("(SELECT * FROM t_orders ORDER BY delivered_customer_date DESC NULLS FIRST, order_id)", _ORDER_DATES)
SQL["upsert_by_key"] = out(
    """(SELECT * FROM complete_user_orders QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY customer_city = 'retry' DESC,
  ingested_at DESC NULLS LAST) = 1)""",
    "purchase_date", stamps="ingested_at",
)
SQL["retention_filter"] = out(
    "staging_user_order_items", stamps="ingested_at", where="ingested_at IS NULL OR ingested_at >= TIMESTAMP '2001-06-01' - INTERVAL 14 DAY"
)
SQL["stored_upsert"] = SQL["upsert_by_key"]
SQL["upsert_keys"] = """
SELECT request_id, CAST(bool_and(customer_city = 'retry') AS INTEGER) AS inserted FROM complete_user_orders
GROUP BY request_id HAVING bool_or(customer_city = 'retry')"""
_ONLINE = {
    "staging_user_orders": "staging_user_orders", "staging_user_order_items": "staging_user_order_items",
    "staging_user_payments": "staging_user_payments", "valid_orders": "u_orders", "valid_items": "u_items",
    "valid_payments": "u_payments", "features": "k_rows",
}
SQL["reset_tables"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows_before, 0 AS rows_after FROM {cte}" for t, cte in _ONLINE.items()
) + " UNION ALL SELECT 'refused_features', count(*), count(*) FROM k_refused"
SQL["retention_tables"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows_before, "
    "count(*) FILTER (WHERE ingested_at IS NULL OR ingested_at >= TIMESTAMP '2001-06-01' - INTERVAL 14 DAY) AS rows_after "
    f"FROM {cte}" for t, cte in _ONLINE.items()
) + " UNION ALL SELECT 'refused_features', count(*), count(*) FROM k_refused"

# ---- survival
SQL["censor_durations"] = out("s_rows", "t_pred_date", drop="n_orders")
SQL["survival_target"] = """
SELECT id, CAST(has_second_purchase AS INTEGER) AS event, CAST(CAST(days_until_second_purchase AS FLOAT) AS DOUBLE) AS duration FROM s_rows"""
SQL["split_temporal_stratified"] = """
SELECT id, has_second_purchase, CASE WHEN pos < floor(floor(n * CAST(0.8 AS DOUBLE)) * 7 / 8) THEN 'train'
  WHEN pos < floor(n * CAST(0.8 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY has_second_purchase ORDER BY t_pred_date, id) - 1 AS pos,
  count(*) OVER (PARTITION BY has_second_purchase) AS n FROM s_rows)"""
SQL["stratified_folds"] = """
SELECT id, has_second_purchase, CAST((row_number() OVER (PARTITION BY has_second_purchase ORDER BY md5('13:' || id)) - 1) % 5 AS INTEGER) AS fold FROM s_rows"""
SQL["permute_column"] = """
SELECT a.id, b.risk_score FROM (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM s_rows) a
JOIN (SELECT risk_score, row_number() OVER (ORDER BY md5('13:0:' || id)) AS pos FROM s_rows) b USING (pos)"""
SQL["person_period"] = """
SELECT id, period, CASE WHEN has_second_purchase = 1 AND period = greatest((days_until_second_purchase - 1) // 30, 0) THEN 1 ELSE 0 END AS period_event
FROM (SELECT *, unnest(range(0, greatest((days_until_second_purchase - 1) // 30, 0) + 1)) AS period FROM s_rows WHERE days_until_second_purchase >= 0)"""
SQL["survival_summaries"] = """
SELECT id, min(t) FILTER (WHERE s <= 0.5) AS median_days_until_second_purchase,
  coalesce(sum((t - pt) * (s + ps) / 2), 0) AS restricted_mean_survival_days
FROM (SELECT *, lag(t) OVER (PARTITION BY id ORDER BY i) AS pt, lag(s) OVER (PARTITION BY id ORDER BY i) AS ps FROM survival_curve_points) GROUP BY id"""
SQL["kaplan_meier"] = """
SELECT duration, CAST(at_risk AS BIGINT) AS at_risk, events, round(product(1 - CAST(events AS DOUBLE) / at_risk) OVER (ORDER BY duration), 6) AS survival,
  round(sum(CAST(events AS DOUBLE) / at_risk) OVER (ORDER BY duration), 6) AS cumulative_hazard
FROM (SELECT days_until_second_purchase AS duration, CAST(sum(has_second_purchase) AS BIGINT) AS events,
    sum(count(*)) OVER (ORDER BY days_until_second_purchase DESC) AS at_risk FROM s_rows GROUP BY 1)"""


def _pairs(risk: str) -> str:
    comparable = """a.has_second_purchase = 1 AND (b.days_until_second_purchase > a.days_until_second_purchase
  OR (b.days_until_second_purchase = a.days_until_second_purchase AND b.has_second_purchase = 0))"""
    return f"""SELECT count(*) FILTER (WHERE a.{risk} > b.{risk}) AS good, count(*) FILTER (WHERE a.{risk} < b.{risk}) AS bad,
  count(*) FILTER (WHERE a.{risk} = b.{risk}) AS ties FROM s_rows a JOIN s_rows b ON {comparable}"""


SQL["c_index"] = f"""
SELECT CAST(good AS DOUBLE) AS concordant, CAST(bad AS DOUBLE) AS discordant, CAST(ties AS DOUBLE) AS tied_risk,
  (good + CAST(ties AS DOUBLE) / 2) / (good + bad + ties) AS c_index FROM ({_pairs("risk_score")})"""
SQL["select_features"] = f"""
SELECT feature, round(importance, 6) AS importance FROM (
  SELECT 'risk_score' AS feature, (good + CAST(ties AS DOUBLE) / 2) / (good + bad + ties) - 0.5 AS importance FROM ({_pairs("risk_score")})
  UNION ALL SELECT 'n_orders', (good + CAST(ties AS DOUBLE) / 2) / (good + bad + ties) - 0.5 FROM ({_pairs("n_orders")})
) WHERE importance >= -0.005"""

# ---- models: facts about the fitted models
CTES["m_rows"] = """
SELECT order_id, t_pred_date, has_second_purchase,
  coalesce(days_until_second_purchase, CAST(DATE '2018-09-03' - t_pred_date AS INTEGER)) AS days FROM wide"""
CTES["m_split"] = """
SELECT *, CASE WHEN pos < floor(floor(n * CAST(0.8 AS DOUBLE)) * 7 / 8) THEN 'train'
  WHEN pos < floor(n * CAST(0.8 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY has_second_purchase ORDER BY t_pred_date, order_id) - 1 AS pos,
  count(*) OVER (PARTITION BY has_second_purchase) AS n FROM m_rows WHERE days >= 0)"""
SQL["score_risk"] = "SELECT order_id, 1 AS risk_in_bounds FROM m_split WHERE split = 'test'"
SQL["permutation_importance"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 1 AS importance_in_bounds" for c in PURCHASE_TIME_COLUMNS if c not in UNTRAINED_COLUMNS
)
SQL["grid_search"] = """
SELECT d AS max_depth, l AS min_instances_per_node, t AS num_trees, 1 AS c_index_in_bounds
FROM (VALUES (5), (10), (15)) a(d), (VALUES (50), (75), (100)) b(l), (VALUES (100), (200)) c(t)"""
SQL["model_metadata"] = """
SELECT 'HazardForestModel' AS model_type, 27 AS num_selected_features, 200 AS num_trees, 15 AS max_depth, 100 AS min_instances_per_node,
  CAST(count(*) AS BIGINT) AS test_rows, 1 AS c_index_in_bounds FROM m_split WHERE split = 'test'"""
SQL["train_modes"] = """
SELECT mode, features_kept, 1 AS c_index_in_bounds, 1 AS reloaded_scores_equal
FROM (VALUES ('base', 34), ('fast', 27)) AS m(mode, features_kept)"""
_SCORED = " AND ".join(f"{c} IS NOT NULL" for c in _REQUIRED)
SQL["score_requests"] = f"""
SELECT request_id, 1 AS risk_in_bounds, 1 AS median_recomputed, 1 AS mean_recomputed, 1 AS has_note FROM k_rows WHERE {_SCORED}"""
SQL["stream_score"] = SQL["score_requests"]

# ---- streaming: the batch result over the same rows
SQL["stream_ingest"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, request_id, count(*) AS staged_rows FROM {t} WHERE request_id IS NOT NULL GROUP BY request_id"
    for t in ("staging_user_orders", "staging_user_order_items", "staging_user_payments")
)
SQL["stream_validate"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, request_id, count(*) AS table_rows FROM {cte} WHERE request_id IS NOT NULL GROUP BY request_id"
    for name, cte in (
        ("orders", "u_orders"), ("payments", "u_payments"), ("items", "u_items"), ("rejected_user_orders", "x_orders"),
        ("rejected_user_payments", "x_payments"), ("rejected_user_order_items", "x_items"),
    )
)
SQL["stream_latest_wins"] = SQL["online_orders_valid"]
SQL["stream_retries"] = """
SELECT request_id, count(*) AS payloads, CAST(min(ingested_at) AS VARCHAR) AS first_arrival FROM (
  SELECT request_id, customer_city, purchase_date, min(CAST(ingested_at AS DATE)) AS ingested_at FROM staging_user_orders
  WHERE request_id IS NOT NULL GROUP BY ALL) GROUP BY request_id"""

ORACLE = {name: compose(sql) for name, sql in SQL.items()}
