"""Prediction requests in bulk: validate, gate, feature rows.

All functions take many requests at once; the request is part of every key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import casts
from ledgerloom.operators.dedupe import dedupe_latest, first_per_key
from ledgerloom.operators.rules import Rule, first_reason
from ledgerloom.plans import features, history, items, rollups
from ledgerloom.session import Keep, materialize, unstored
from ledgerloom.sources.schemas import REQUEST_COLUMNS

# Defaults for missing text.
DEFAULT_STATUS = "created"
DEFAULT_PAYMENT_TYPE = "credit_card"
UNKNOWN_CATEGORY = "unknown"

# Columns of a feature row that may not be NULL.
REQUIRED_FEATURES = [
    "most_freq_payment_type_encoded", "payment_type_count", "total_installments", "total_payment_value",
    "num_items_in_order", "total_freight_value", "total_merch_value", "total_order_value", "avg_price", "price_std",
    "min_price", "price_range", "freight_price_ratio", "max_freight_ratio", "min_freight_ratio",
    "has_multiple_seller_states", "num_seller_states", "latest_shipping_limit_date", "shipping_window_days",
    "most_exp_product_id", "most_exp_price", "most_exp_freight", "most_exp_prod_category",
    "most_exp_encoded_category", "most_freq_category", "most_freq_encoded_category", "num_distinct_categories",
    "most_freq_cat_concentration", "val_seller_id", "val_seller_zip", "val_seller_city", "val_seller_state",
    "val_seller_encoded_state", "has_duplicate_sellers", "has_multiple_sellers", "num_distinct_sellers",
    "avg_seller_price", "avg_seller_freight", "seller_order_volume", "seller_item_volume",
]
ENCODED = {
    "most_freq_payment_type_encoded", "most_exp_encoded_category", "most_freq_encoded_category",
    "val_seller_encoded_state",
}
# Columns the serving table keeps with two decimals.
TWO_DECIMALS = [
    "total_payment_value", "total_freight_value", "total_merch_value", "total_order_value", "avg_price", "price_std",
    "min_price", "price_range", "most_exp_price", "most_exp_freight", "avg_seller_price", "avg_seller_freight",
]


# The typed request id, where it is kept beside the raw rows, and what it cut off.
TYPED_ID = "_request"
ID_REST = "_request_rest"
ID_LENGTH = 50


# ---- typed rows -------------------------------------------------------------------------


def split_id(raw: DataFrame) -> DataFrame:
    """Raw rows with the typed request id and the rest of the raw one in place of it. Rows stored in
    buckets of the typed id are checked where they lie, as the typed rows go by the same column. Rows
    that were dealt by their typed id hold it already."""
    rest = F.when(F.length("request_id") > ID_LENGTH, F.substr("request_id", F.lit(ID_LENGTH + 1)))
    others = [c for c in raw.columns if c not in ("request_id", TYPED_ID)]
    return raw.select(_typed_id(raw).alias(TYPED_ID), rest.alias(ID_REST), *others)


def whole_id(split: DataFrame) -> DataFrame:
    """The raw rows again, first the raw id, with the typed id beside them; results do not hold it."""
    whole = F.when(F.col(ID_REST).isNull(), F.col(TYPED_ID)).otherwise(F.concat(TYPED_ID, ID_REST))
    others = [c for c in split.columns if c not in (TYPED_ID, ID_REST)]
    return split.select(whole.alias("request_id"), *others, TYPED_ID)


def _typed_id(raw: DataFrame) -> Column:
    return F.col(TYPED_ID) if TYPED_ID in raw.columns else casts.varchar("request_id", ID_LENGTH)


def _raw_columns(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != TYPED_ID]


def _join_valid(raw: DataFrame, valid: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join by the raw request id and more. A valid row's id is a typed one, so a raw id
    that equals it equals its own typed id too: that key changes no result."""
    if TYPED_ID not in raw.columns:
        return raw.join(valid, keys, how)
    return raw.join(valid.withColumn(TYPED_ID, F.col("request_id")), [TYPED_ID, *keys], how)


def valid_orders(raw: DataFrame) -> DataFrame:
    """Newest complete order row of each request."""
    typed = raw.select(
        _typed_id(raw).alias("request_id"),
        *(casts.varchar(c, 50).alias(c) for c in ("order_id", "customer_id", "customer_unique_id")),
        casts.digits_to_int("customer_zip").alias("customer_zip"),
        casts.varchar("customer_city", 50).alias("customer_city"),
        casts.varchar("customer_state", 3).alias("customer_state"),
        F.coalesce(casts.varchar("order_status", 25), F.lit(DEFAULT_STATUS)).alias("order_status"),
        casts.any_date("purchase_date").alias("purchase_date"),
        "ingested_at",
    )
    complete = typed.na.drop(subset=[c for c in typed.columns if c != "ingested_at"])
    return dedupe_latest(complete, ["request_id"])


def _of_known_order(typed: DataFrame, orders: DataFrame) -> DataFrame:
    keys = ["request_id", "order_id"]
    return typed.join(orders.select(*keys), keys, "left_semi").select(*typed.columns)


def valid_payments(raw: DataFrame, orders: DataFrame) -> DataFrame:
    typed = raw.select(
        _typed_id(raw).alias("request_id"),
        casts.varchar("order_id", 50).alias("order_id"),
        casts.digits_to_int("payment_sequential").alias("payment_sequential"),
        F.coalesce(casts.varchar("payment_type", 25), F.lit(DEFAULT_PAYMENT_TYPE)).alias("payment_type"),
        casts.digits_to_int("num_installments").alias("num_installments"),
        casts.decimal_text("payment_value").alias("payment_value"),
        "ingested_at",
    )
    complete = typed.na.drop(subset=[c for c in typed.columns if c != "ingested_at"])
    return dedupe_latest(_of_known_order(complete, orders), ["request_id", "payment_sequential"])


def valid_items(raw: DataFrame, orders: DataFrame) -> DataFrame:
    typed = raw.select(
        _typed_id(raw).alias("request_id"),
        casts.varchar("order_id", 50).alias("order_id"),
        casts.digits_to_int("item_id").alias("item_id"),
        casts.varchar("product_id", 50).alias("product_id"),
        casts.varchar("seller_id", 50).alias("seller_id"),
        casts.any_date("shipping_limit_date").alias("shipping_limit_date"),
        casts.decimal_text("price").alias("price"),
        casts.decimal_text("freight_value").alias("freight_value"),
        F.coalesce("product_category_name", F.lit(UNKNOWN_CATEGORY)).alias("product_category_name"),
        casts.digits_to_int("seller_zip").alias("seller_zip"),
        casts.varchar("seller_city", 50).alias("seller_city"),
        casts.varchar("seller_state", 3).alias("seller_state"),
        "ingested_at",
    )
    complete = typed.na.drop(subset=[c for c in typed.columns if c != "ingested_at"])
    return dedupe_latest(_of_known_order(complete, orders), ["request_id", "item_id"])


# ---- refused rows -----------------------------------------------------------------------
# The reason texts below are fixed values.


def _null(column: str, kind: str = "NULL") -> Rule:
    return F.col(column).isNull(), f"{kind} {column}"


def _bad(column: str, pattern: str, padded: bool = False) -> Rule:
    value = F.trim(column) if padded else F.col(column)
    return F.col(column).isNull() | ~value.rlike(pattern), f"Invalid {column}"


def _bad_date(column: str) -> Rule:
    value = F.col(column)
    fits = value.rlike(casts.DATE_TEXT) | value.rlike(casts.TIMESTAMP_TEXT)
    return value.isNull() | ~fits, f"Invalid {column}"


def _blank(column: str) -> Rule:
    return F.col(column) == "", f"Empty {column}"


def _reason(rules: list[Rule], table: str, locator: str | None = None) -> Column:
    """First problem, the table, and for rows below the order the number of the row."""
    where = f" in table {table}"
    text = F.concat(first_reason(rules, F.lit("Unknown validation error")), F.lit(where))
    if locator is None:
        return text
    numbered = F.format_string(f"%s, {locator} %s", text, F.coalesce(F.col(locator), F.lit("NULL")))
    blank = [r for r in rules if r[1].startswith("Empty")]
    return F.when(first_reason(blank).isNotNull(), text).otherwise(numbered)


def rejected_orders(raw: DataFrame, valid: DataFrame) -> DataFrame:
    """Rows of requests without any complete order row."""
    rules = [
        _null("request_id"), _null("order_id"), _null("customer_id"), _null("customer_unique_id"),
        _bad("customer_zip", casts.DIGITS_TEXT), _null("customer_city"), _null("customer_state"),
        _bad_date("purchase_date"),
    ]
    lost = _join_valid(raw, valid.select("request_id"), ["request_id"], "left_anti")
    return lost.withColumn("rejected_reason", _reason(rules, "staging_user_orders")).select(
        *_raw_columns(raw), "rejected_reason"
    )


def _lost_rows(raw: DataFrame, valid: DataFrame, number: str) -> DataFrame:
    """Rows with no valid row of the same request, order and number."""
    keyed = raw.withColumn("_number", casts.digits_to_int(number))
    known = valid.select("request_id", "order_id", F.col(number).alias("_number"))
    return _join_valid(keyed, known, ["request_id", "order_id", "_number"], "left_anti")


def rejected_payments(raw: DataFrame, valid: DataFrame) -> DataFrame:
    rules = [
        _blank("request_id"), _blank("order_id"), _null("request_id"), _null("order_id"),
        _bad("payment_sequential", casts.DIGITS_TEXT), _bad("num_installments", casts.DIGITS_TEXT),
        _bad("payment_value", casts.DECIMAL_TEXT, padded=True),
    ]
    reason = _reason(rules, "staging_user_payments", "payment_sequential")
    return _lost_rows(raw, valid, "payment_sequential").withColumn("rejected_reason", reason).select(
        *_raw_columns(raw), "rejected_reason"
    )


def rejected_items(raw: DataFrame, valid: DataFrame) -> DataFrame:
    rules = [
        _blank("request_id"), _blank("order_id"), _null("request_id"), _null("order_id"),
        _bad("item_id", casts.DIGITS_TEXT), _null("product_id"), _null("seller_id"),
        _bad_date("shipping_limit_date"), _bad("price", casts.DECIMAL_TEXT, padded=True),
        _bad("freight_value", casts.DECIMAL_TEXT, padded=True), _bad("seller_zip", casts.DIGITS_TEXT),
        _null("seller_city"), _null("seller_state"),
    ]
    reason = _reason(rules, "staging_user_order_items", "item_id")
    return _lost_rows(raw, valid, "item_id").withColumn("rejected_reason", reason).select(
        *_raw_columns(raw), "rejected_reason"
    )


def validate(
    raw: dict[str, DataFrame], keep: Keep = unstored, owners: Callable[[DataFrame], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Valid and refused rows of the three request tables.

    An order belongs to one request. ``owners`` maps complete order rows to (order_id, request_id)
    of the requests that own their orders, where earlier requests are known; without it the
    earliest of the given requests does. Rows of a request without its order are refused.
    """
    raw_orders, raw_items, raw_payments = (raw[t] for t in REQUEST_COLUMNS)
    complete = keep({"complete_orders": valid_orders(raw_orders)})["complete_orders"]
    owned = (owners or order_owners)(complete)
    orders = keep({"valid_orders": complete.join(owned, ["order_id", "request_id"], "left_semi").select(*complete.columns)})["valid_orders"]
    refused_orders = rejected_orders(raw_orders, complete).unionByName(refused_conflicts(raw_orders, complete, orders))
    valid = keep(
        {
            "valid_payments": valid_payments(raw_payments, orders),
            "valid_items": valid_items(raw_items, orders),
            "rejected_user_orders": refused_orders,
        }
    )
    refused = keep(
        {
            "rejected_user_payments": rejected_payments(raw_payments, valid["valid_payments"]),
            "rejected_user_order_items": rejected_items(raw_items, valid["valid_items"]),
        }
    )
    return {
        "orders": orders,
        "payments": valid["valid_payments"],
        "items": valid["valid_items"],
        "rejected_user_orders": valid["rejected_user_orders"],
        **refused,
    }


REJECTED_TABLES = ("rejected_user_orders", "rejected_user_payments", "rejected_user_order_items")


def _all_rejected(checked: dict[str, DataFrame]) -> DataFrame:
    first, *rest = (
        checked[t].select("request_id", F.lit(t).alias("source_table"), "rejected_reason") for t in REJECTED_TABLES
    )
    for df in rest:
        first = first.unionByName(df)
    return first


def rejected_gate(checked: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Refused rows per table for every submitted request, and whether the request is held."""
    seen = requests.select("request_id", F.lit(None).cast("string").alias("source_table"))
    rows = _all_rejected(checked).drop("rejected_reason").unionByName(seen)
    counts = rows.groupBy("request_id").agg(
        *(
            F.count_if(F.col("source_table") == t).alias(name)
            for t, name in zip(
                REJECTED_TABLES,
                ("rejected_orders_count", "rejected_payments_count", "rejected_items_count"),
                strict=True,
            )
        ),
        F.count("source_table").alias("total_rejected_rows"),
    )
    return counts.withColumn("any_rejected_rows", F.col("total_rejected_rows") > 0)


def rejected_reasons(checked: dict[str, DataFrame]) -> DataFrame:
    return _all_rejected(checked).filter("rejected_reason IS NOT NULL").select("request_id", "rejected_reason")


def pass_gate(
    checked: dict[str, DataFrame], keep: Keep = unstored, held_requests: Keep | None = None
) -> dict[str, DataFrame]:
    """Valid rows of the requests without any refused row. ``keep`` stores them, as features read them
    several times; ``held_requests`` stores the requests held at the gate where the rows are read once."""
    held = _all_rejected(checked).select("request_id").distinct()
    held = (held_requests or keep)({"held_requests": held})["held_requests"]
    return keep(
        {
            name: checked[name].join(held, "request_id", "left_anti").select(*checked[name].columns)
            for name in ("orders", "payments", "items")
        }
    )


CONFLICT = "order_id belongs to another request"


def order_owners(orders: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(order_id, request_id): the owner of each order among complete order rows, one per request.

    An order that has an owner in ``known`` (order_id, request_id) keeps it; else the earliest
    request takes it, the smallest id of equals, and one without a time comes last.
    """
    mine = orders.select("order_id", "request_id", "ingested_at", F.lit(1).alias("_new"))
    if known is not None:
        stamp = F.lit(None).cast(mine.schema["ingested_at"].dataType)
        theirs = known.select("order_id", "request_id", stamp.alias("ingested_at"), F.lit(0).alias("_new"))
        # Owners of orders that no request names are not looked at.
        mine = mine.unionByName(theirs.join(orders.select("order_id"), "order_id", "left_semi").select(*mine.columns))
    first = first_per_key(mine, ["order_id"], [F.col("_new"), F.col("ingested_at").asc_nulls_last(), F.col("request_id")])
    return first.select("order_id", "request_id")


def order_conflicts(orders: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Requests that name an order of another request, and that request."""
    owners = order_owners(orders, known).withColumnRenamed("request_id", "owner_id")
    late = orders.join(owners, "order_id").filter("owner_id <> request_id")
    return late.select("request_id", "order_id", "owner_id", F.lit(CONFLICT).alias("rejected_reason"))


def refused_conflicts(raw: DataFrame, complete: DataFrame, owned: DataFrame) -> DataFrame:
    """All order rows of the requests that have a complete order row but not the order."""
    late = complete.join(owned.select("request_id"), "request_id", "left_anti").select("request_id")
    lost = _join_valid(raw, late, ["request_id"], "left_semi").select(*_raw_columns(raw))
    return lost.withColumn("rejected_reason", F.lit(f"{CONFLICT} in table staging_user_orders"))


# ---- features ---------------------------------------------------------------------------


def _by_request(df: DataFrame) -> DataFrame:
    """Feature rollups are keyed by ``order_id``; a request has one order, so its id serves as
    the key even if another request names the same order."""
    return df.withColumn("order_id", F.col("request_id"))


def history_of_requests(passed: dict[str, DataFrame], base: DataFrame) -> DataFrame:
    """Seller history with the requests' own rows, for the sellers of the requests only: the base
    is cut to them before the merge."""
    new = history.online_history(passed["orders"], passed["items"])
    return history.upsert_history(history.of_sellers(base, history.stored_sellers(passed["items"])), new)


def request_features(
    passed: dict[str, DataFrame],
    encodings: dict[str, DataFrame],
    seller_history: DataFrame,
    typed: bool = False,
    strictly_before_day: bool = False,
) -> DataFrame:
    """One feature row per request; the history must already hold the requests' own rows.

    Only the history of sellers seen in the requests is windowed. ``typed=True`` rounds amounts and
    averages to two decimals.
    """
    lines = items.online_items_joined(_by_request(passed["items"]), encodings)
    item_features = items.item_order_features(lines).withColumnRenamed("order_id", "request_id")
    payments = rollups.payment_rollup(_by_request(passed["payments"]), encodings["payment_type"])
    payments = payments.drop("payment_type").withColumnRenamed("order_id", "request_id")
    scoped = history.of_sellers(seller_history, history.stored_sellers(passed["items"]))
    scoped = materialize(scoped, "history_scoped")
    to_date = history.seller_history_to_date(scoped, strictly_before_day).withColumnRenamed(
        "seller_id", "val_seller_id"
    )
    rows = (
        passed["orders"]
        .join(payments, "request_id")
        .join(item_features, "request_id")
        .join(to_date, ["order_id", "val_seller_id"])
        .withColumn("t_pred_date", F.col("purchase_date"))
        .withColumns(features.calendar_features())
    )
    view = [c for c in features.PURCHASE_TIME_COLUMNS if c in rows.columns]
    rows = rows.select("request_id", *view, "ingested_at")
    if typed:
        rows = rows.withColumns({c: F.round(F.col(c).cast("decimal(20,6)"), 2).cast("decimal(10,2)") for c in TWO_DECIMALS})
    return rows


def _missing_feature() -> Column:
    return F.coalesce(
        *(
            F.when(F.col(c).isNull(), F.lit(("unseen " if c in ENCODED else "NULL ") + c))
            for c in REQUIRED_FEATURES
        )
    )


def complete_features(rows: DataFrame) -> DataFrame:
    return rows.na.drop(subset=REQUIRED_FEATURES)


def refused_features(rows: DataFrame) -> DataFrame:
    """Requests whose feature row is incomplete, for example for a value the encodings never saw."""
    reason = _missing_feature()
    return rows.filter(reason.isNotNull()).select("request_id", reason.alias("rejected_reason"))


def train_serve_parity(offline: DataFrame, online: DataFrame) -> DataFrame:
    """Per feature column: orders present on both sides and how many of them differ."""
    names = [c for c in features.PURCHASE_TIME_COLUMNS if c in online.columns and c != "order_id"]
    pairs = offline.select("order_id", *names).alias("a").join(online.select("order_id", *names).alias("b"), "order_id")
    counts = pairs.agg(
        F.count("*").alias("_orders"),
        *(F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in names),
    )
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("differing_orders")) for c in names))
    return counts.select("_orders", F.explode(rows).alias("r")).select(
        F.col("r.feature").alias("feature"),
        F.col("_orders").alias("compared_orders"),
        F.col("r.differing_orders").alias("differing_orders"),
    )
