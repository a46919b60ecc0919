"""Order targets, dated features and the wide table of first purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.calendar import day_of_week, days_between, on_weekend
from ledgerloom.functions.numbers import flag
from ledgerloom.operators.dedupe import first_per_key
from ledgerloom.plans import encode, history, items, rollups
from ledgerloom.session import Keep, small, unstored

# Columns known at purchase time.
PURCHASE_TIME_COLUMNS = [
    "order_id", "customer_id", "order_status", "purchase_date", "t_pred_date", "has_second_purchase",
    "days_until_second_purchase", "customer_unique_id", "customer_zip",
    "purchase_month", "purchase_day_of_week", "purchased_on_weekend",
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

# Identifiers, labels and text that no model is trained on.
UNTRAINED_COLUMNS = [
    "order_id", "customer_id", "order_status", "purchase_date", "t_pred_date", "has_second_purchase",
    "days_until_second_purchase", "customer_unique_id", "customer_zip", "latest_shipping_limit_date",
    "most_exp_product_id", "most_exp_prod_category", "most_freq_category", "val_seller_id", "val_seller_zip",
    "val_seller_city", "val_seller_state", "total_order_value", "request_id", "ingested_at",
]


def order_targets(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their person, the person's number of orders and the date of the next order.

    Orders without a person form one group that can be large. Orders are therefore summed per
    (person, day) first; the window then sees one row per day of a person.
    """
    person = customers.select(
        "customer_id", "customer_unique_id", F.col("zip_code").alias("customer_zip"), "city", "customer_state"
    )
    joined = orders.join(person, "customer_id", "left")
    daily = joined.groupBy("customer_unique_id", "purchase_date").agg(
        F.count("*").alias("_orders"), F.max("order_id").alias("_last_order")
    )
    days = Window.partitionBy("customer_unique_id")
    daily = daily.select(
        F.col("customer_unique_id").alias("_person"),
        F.col("purchase_date").alias("_day"),
        "_last_order",
        F.sum("_orders").over(days).alias("total_purchases_by_customer"),
        F.lead("purchase_date").over(days.orderBy("purchase_date")).alias("_next_day"),
    )
    same_day = F.col("customer_unique_id").eqNullSafe(F.col("_person")) & (F.col("purchase_date") == F.col("_day"))
    return joined.join(daily, same_day).select(
        "order_id", "customer_id", "order_status", "purchase_date",
        F.col("purchase_date").alias("t_pred_date"),
        F.coalesce("order_approval_date", "purchase_date").alias("order_approval_date"),
        "delivered_carrier_date", "delivered_customer_date", "estimated_delivery_date",
        "total_purchases_by_customer",
        F.when(F.col("order_id") < F.col("_last_order"), F.col("purchase_date"))
        .otherwise(F.col("_next_day")).alias("second_purchase_date"),
        "customer_unique_id", "customer_zip", "city", "customer_state",
    )


def calendar_features() -> dict[str, Column]:
    return {
        "purchase_month": F.month("purchase_date"),
        "purchase_day_of_week": day_of_week("purchase_date"),
        "purchased_on_weekend": on_weekend("purchase_date"),
    }


def survival_labels() -> dict[str, Column]:
    """``event_consistent`` marks rows with a known next date; the count based label also counts
    orders before the kept one."""
    return {
        "has_second_purchase": flag(F.col("total_purchases_by_customer") > 1),
        "days_until_second_purchase": days_between("second_purchase_date", "purchase_date"),
        "event_consistent": flag(F.col("second_purchase_date").isNotNull()),
    }


def delivery_features() -> dict[str, Column]:
    """Over order targets joined with item features."""
    carrier = F.coalesce("delivered_carrier_date", "latest_shipping_limit_date")
    return {
        "total_order_duration_days": days_between("delivered_customer_date", "purchase_date"),
        "late_delivery": flag(F.col("delivered_customer_date") > F.col("estimated_delivery_date")),
        "early_delivery_days": days_between("estimated_delivery_date", "delivered_customer_date"),
        "total_delivery_days": days_between("delivered_customer_date", "order_approval_date"),
        "carrier_to_customer_delivery_days": days_between("delivered_customer_date", carrier),
        "order_approval_days": days_between("order_approval_date", "purchase_date"),
        "late_seller_dispatch": flag(F.col("latest_shipping_limit_date") < carrier),
        "seller_dispatch_before_deadline_days": days_between("latest_shipping_limit_date", carrier),
        "total_days_to_dispatch_last_item": days_between("latest_shipping_limit_date", "order_approval_date"),
    }


def review_timing_features() -> dict[str, Column]:
    """Over order targets left-joined with the review rollup."""
    first, delivered = F.col("first_review_date"), F.col("delivered_customer_date")
    estimated = F.col("estimated_delivery_date")
    return {
        "premature_review": flag((first < delivered) & (first < estimated)),
        "late_delivery_review": flag((first < delivered) & (first > estimated)),
        "delivery_to_first_review_days": F.coalesce(days_between(first, delivered), F.lit(-1)),
        "delivery_to_last_review_days": F.coalesce(days_between("latest_review_date", delivered), F.lit(-1)),
        "has_review_by_t_pred": flag(F.col("num_reviews").isNotNull()),
        "has_answer_by_t_pred": flag(F.col("has_review_answer") == 1),
        **{
            c: F.coalesce(F.col(c), F.lit(0))
            for c in (
                "average_review_score", "has_review_message", "has_message_proportion", "has_multiple_reviews",
                "num_reviews", "has_review_answer", "received_answer_proportion",
            )
        },
        **{c: F.coalesce(F.col(c), F.lit(-1)) for c in ("max_answer_time_days", "min_answer_time_days")},
    }


def same_state_order() -> Column:
    """An order from sellers of several states is never a same-state order."""
    return flag(
        (F.col("has_multiple_seller_states") != 1) & (F.col("customer_state") == F.col("val_seller_state"))
    )


def _with(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    # One projection: every expression reads the input columns, not each other's results.
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items()))


def delivered(targets: DataFrame) -> DataFrame:
    return targets.filter("order_status = 'delivered' AND delivered_customer_date IS NOT NULL")


def _star(targets: DataFrame, payments: DataFrame, item_features: DataFrame, history_to_date: DataFrame) -> DataFrame:
    """Everything is keyed by order; the history side is cut to one row per order first."""
    with_history = item_features.join(
        history_to_date.withColumnRenamed("seller_id", "val_seller_id"), ["order_id", "val_seller_id"]
    )
    return targets.join(payments.drop("payment_type"), "order_id").join(with_history, "order_id")


def first_order_per_customer(df: DataFrame) -> DataFrame:
    return first_per_key(df, ["customer_unique_id"], [F.col("purchase_date").asc(), F.col("order_id").asc()])


def customer_features_wide(
    targets: DataFrame,
    payments: DataFrame,
    reviews: DataFrame,
    item_features: DataFrame,
    history_to_date: DataFrame,
) -> DataFrame:
    """One row per person: the first delivered order with all features and labels."""
    joined = _star(delivered(targets), payments, item_features, history_to_date)
    first = first_order_per_customer(joined).join(reviews, "order_id", "left")
    derived = {
        **calendar_features(), **survival_labels(), **delivery_features(), **review_timing_features(),
        "same_state_order": same_state_order(),
        "delivered_carrier_date": F.coalesce("delivered_carrier_date", "latest_shipping_limit_date"),
    }
    return _with(first, derived).drop("total_purchases_by_customer", "second_purchase_date", "city", "customer_state")


def purchase_time_view(
    targets: DataFrame, payments: DataFrame, item_features: DataFrame, history_to_date: DataFrame
) -> DataFrame:
    """The columns known at purchase time; the reviews are not joined at all."""
    joined = _star(delivered(targets), payments, item_features, history_to_date)
    first = first_order_per_customer(joined)
    return _with(first, {**calendar_features(), **survival_labels()}).select(*PURCHASE_TIME_COLUMNS)


def trainable(df: DataFrame) -> DataFrame:
    return df.drop(*UNTRAINED_COLUMNS)


def serving_inputs(typed: dict[str, DataFrame], keep: Keep = unstored) -> dict:
    """What request features need of the typed tables: the encodings and the seller history."""
    frozen = keep({**encode.encode_all(typed), "history": history.seller_history_base(typed["item_orders"], typed["orders"])})
    return {"history": frozen.pop("history"), "encodings": frozen}


def feature_inputs(typed: dict[str, DataFrame], keep: Keep = unstored, serving: dict | None = None) -> dict:
    """The inputs of the wide table from the typed tables (without reviews if they are not there);
    ``serving`` holds those that are there already."""
    serving = serving or serving_inputs(typed, keep)
    base, encodings = serving["history"], serving["encodings"]
    stored = {} if keep is unstored else {"sized": small}
    joined = items.order_items_joined(typed["item_orders"], typed["products"], typed["sellers"], encodings, **stored)
    joined = keep({"items_joined": joined})["items_joined"]
    reviews = {"reviews": rollups.review_rollup(typed["reviews"], typed["orders"])} if "reviews" in typed else {}
    return {
        **reviews,
        "targets": order_targets(typed["orders"], typed["customers"]),
        "payments": rollups.payment_rollup(typed["payments"], encodings["payment_type"]),
        "item_features": items.item_order_features(joined),
        "history_to_date": history.seller_history_to_date(base),
        "encodings": encodings,
        "history": base,
    }


def wide_from_typed(typed: dict[str, DataFrame], keep: Keep = unstored) -> DataFrame:
    parts = feature_inputs(typed, keep)
    return customer_features_wide(
        parts["targets"], parts["payments"], parts["reviews"], parts["item_features"], parts["history_to_date"]
    )


def view_from_typed(typed: dict[str, DataFrame], keep: Keep = unstored) -> DataFrame:
    parts = feature_inputs(typed, keep)
    return purchase_time_view(
        parts["targets"], parts["payments"], parts["item_features"], parts["history_to_date"]
    )
