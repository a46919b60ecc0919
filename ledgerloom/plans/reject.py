"""Rows dropped by the cleaning stage: the refused rows with the first reason that applies, and an
audit of every dropped row. Both come from one ordered rule list per table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import casts
from ledgerloom.operators.dedupe import dedupe_total_order
from ledgerloom.operators.parents import mark_missing
from ledgerloom.operators.rules import Rule, first_reason, refused
from ledgerloom.plans import clean


def _no_order(raw: DataFrame, orders: DataFrame) -> DataFrame:
    """Mark ``order_id NOT IN orders``. A raw id that equals a typed one equals its own typed id, so rows
    dealt by the typed id are joined by it too."""
    if clean.TYPED_ORDER not in raw.columns:
        return mark_missing(raw, "order_id", orders, "_no_order")
    keys = orders.select("order_id").dropna().distinct()
    keys = keys.select(F.col("order_id").alias(clean.TYPED_ORDER), "order_id", F.lit(True).alias("_known"))
    marked = raw.join(keys, [clean.TYPED_ORDER, "order_id"], "left")
    return marked.select(*raw.columns, F.when(F.col("order_id").isNotNull(), F.col("_known").isNull()).alias("_no_order"))


def _no_product(raw: DataFrame, products: DataFrame) -> DataFrame:
    if clean.PRODUCT_CATEGORY not in raw.columns:
        return mark_missing(raw, "product_id", products, "_no_product")
    # The category was found by the typed id, which a longer raw id is not.
    missing = F.col(clean.PRODUCT_CATEGORY).isNull() | (F.length("product_id") > clean.ID_LENGTH)
    return raw.withColumn("_no_product", F.when(F.col("product_id").isNotNull(), missing))


def _null(column: str, reason: str) -> Rule:
    return F.col(column).isNull(), reason


def _not(column: Column | str, pattern: str, reason: str) -> Rule:
    value = F.col(column) if isinstance(column, str) else column
    return ~value.rlike(pattern), reason


# The reason texts below are fixed values. A rule without a reason refuses the row silently.


def _order_rules(raw: DataFrame) -> tuple[DataFrame, list[Rule]]:
    return raw, [
        _null("order_id", "NULL order_id"),
        _null("customer_id", "NULL customer_id"),
        _null("purchase_date", "NULL purchase_date"),
        _not("purchase_date", casts.TIMESTAMP_TEXT, "Incorrect purchase_date format"),
    ]


def _seller_rules(raw: DataFrame) -> tuple[DataFrame, list[Rule]]:
    return raw, [_null("seller_id", "seller_id is NULL")]


def _category_rules(raw: DataFrame) -> tuple[DataFrame, list[Rule]]:
    return raw, [_null("product_category", "product_category is NULL")]


def _product_rules(raw: DataFrame, categories: DataFrame) -> tuple[DataFrame, list[Rule]]:
    marked = mark_missing(raw, "product_category_name", categories, "_no_category", "product_category")
    return marked, [
        _null("product_id", "NULL product_id"),
        (F.col("_no_category"), "product_category_name not in parent"),
    ]


def _item_rules(
    raw: DataFrame, orders: DataFrame, sellers: DataFrame, products: DataFrame
) -> tuple[DataFrame, list[Rule]]:
    marked = _no_order(raw, orders)
    marked = mark_missing(marked, "seller_id", sellers, "_no_seller")
    marked = _no_product(marked, products)
    return marked, [
        _null("order_id", "NULL order_id"),
        _null("item_id", "NULL item_id"),
        _null("product_id", "NULL product_id"),
        _null("shipping_limit_date", "NULL shipping_date"),
        _null("seller_id", "NULL seller_id"),
        _not("shipping_limit_date", casts.TIMESTAMP_TEXT, "Incorrect shipping_limit_date format"),
        _not(F.trim("price"), casts.DECIMAL_TEXT, "Incorrect price format"),
        (F.col("_no_order"), "order_id not in final_orders"),
        (F.col("_no_seller"), "seller_id not in final_sellers"),
        (F.col("_no_product"), "product_id not in final_products"),
    ]


def _customer_rules(raw: DataFrame, orders: DataFrame) -> tuple[DataFrame, list[Rule]]:
    return mark_missing(raw, "customer_id", orders, "_no_order"), [
        _null("customer_id", "NULL customer_id"),
        _null("customer_unique_id", "NULL customer_unique_id"),
        (F.col("_no_order"), None),
    ]


def _payment_rules(raw: DataFrame, orders: DataFrame) -> tuple[DataFrame, list[Rule]]:
    return _no_order(raw, orders), [
        _null("order_id", "NULL order_id"),
        _not(F.trim("payment_value"), casts.DECIMAL_TEXT, "Incorrect payment_value format"),
        (F.col("payment_value").isNull(), None),
        (F.col("_no_order"), None),
    ]


def _review_rules(raw: DataFrame, orders: DataFrame) -> tuple[DataFrame, list[Rule]]:
    return _no_order(raw, orders), [
        _null("review_id", "NULL review_id"),
        _null("order_id", "NULL order_id"),
        _null("review_score", "NULL review_score"),
        _null("post_date", "NULL post_date"),
        _not("review_score", casts.SCORE_TEXT, "Incorrect review_Score format"),
        _not("post_date", casts.TIMESTAMP_TEXT, "Incorrect post_date format"),
        (F.col("_no_order"), "order_id not in parent"),
    ]


def _refused(raw: DataFrame, marked_rules: tuple[DataFrame, list[Rule]]) -> DataFrame:
    marked, rules = marked_rules
    return refused(marked, rules).select(*raw.columns, "rejected_reason")


def rejected_orders(raw: DataFrame) -> DataFrame:
    return _refused(raw, _order_rules(raw))


def rejected_sellers(raw: DataFrame) -> DataFrame:
    return _refused(raw, _seller_rules(raw))


def rejected_product_category(raw: DataFrame) -> DataFrame:
    return _refused(raw, _category_rules(raw))


def rejected_products(raw: DataFrame, categories: DataFrame) -> DataFrame:
    return _refused(raw, _product_rules(raw, categories))


def rejected_item_orders(raw: DataFrame, orders: DataFrame, sellers: DataFrame, products: DataFrame) -> DataFrame:
    return _refused(raw, _item_rules(raw, orders, sellers, products))


def rejected_customers(raw: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers without an order are refused without a reason."""
    return _refused(raw, _customer_rules(raw, orders))


def rejected_payments(raw: DataFrame, orders: DataFrame) -> DataFrame:
    """Missing values and payments without an order are refused without a reason."""
    return _refused(raw, _payment_rules(raw, orders))


def rejected_reviews(raw: DataFrame, orders: DataFrame) -> DataFrame:
    return _refused(raw, _review_rules(raw, orders))


def reject_all(raw: dict[str, DataFrame], typed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    orders = typed["orders"]
    return {
        "rejected_orders": rejected_orders(raw["staging_orders"]),
        "rejected_sellers": rejected_sellers(raw["staging_sellers"]),
        "rejected_product_category": rejected_product_category(raw["staging_product_category"]),
        "rejected_products": rejected_products(raw["staging_products"], typed["product_category"]),
        "rejected_item_orders": rejected_item_orders(
            raw["staging_item_orders"], orders, typed["sellers"], typed["products"]
        ),
        "rejected_customers": rejected_customers(raw["staging_customers"], orders),
        "rejected_payments": rejected_payments(raw["staging_payments"], orders),
        "rejected_reviews": rejected_reviews(raw["staging_reviews"], orders),
    }


def _audit(
    raw: DataFrame,
    keys: Sequence[str],
    required: Sequence[str],
    marked_rules: tuple[DataFrame, list[Rule]],
    more: Sequence[Rule] = (),
) -> DataFrame:
    """Dropped rows of a table: those that meet a rule, and rows that lost to another row of
    their key. Rows equal in every column are counted in ``copies``.

    A bad row may win its key and shadow good ones; those are duplicates here, as in the cleaning.
    """
    marked, rules = marked_rules
    problem = first_reason([*(r for r in rules if r[1] is not None), *more])
    columns = clean.raw_columns(raw)
    dealt = [clean.TYPED_ORDER] if clean.TYPED_ORDER in raw.columns else []
    whole = reduce(and_, (F.col(c).isNotNull() for c in required))
    groups = marked.groupBy(*marked.columns).agg(F.count("*").alias("copies"))
    if dealt:
        # Rows of a key lie together, so the winner is found among them, as in the cleaning. Incomplete rows
        # never win: they come after the whole ones.
        rest = [F.col(c).asc_nulls_last() for c in columns if c not in keys]
        first = F.row_number().over(Window.partitionBy(*dealt, *keys).orderBy(whole.desc(), *rest)) == 1
        joined = groups.withColumn("_wins", whole & first)
    else:
        winner = dedupe_total_order(raw.na.drop(subset=list(required)), keys).withColumn("_wins", F.lit(True))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"w.{c}")) for c in columns]
        joined = groups.alias("a").join(winner.alias("w"), same, "left").select("a.*", F.col("w._wins").alias("_wins"))
    kept = F.when(F.col("_wins") & F.col("_problem").isNull(), 1).otherwise(0)
    return (
        joined.withColumn("_problem", problem)
        .withColumn("copies", F.col("copies") - kept)
        .withColumn("rejected_reason", F.coalesce("_problem", F.lit(f"duplicate {', '.join(keys)}")))
        .filter("copies > 0")
        .select(*columns, "copies", "rejected_reason")
    )


def _lost(column: Column, reason: str) -> Rule:
    return column.isNull(), reason


def audit_orders(raw: DataFrame) -> DataFrame:
    return _audit(
        raw, ["order_id"], ["order_id", "customer_id", "purchase_date"], _order_rules(raw),
        [_lost(casts.timestamp_to_date("purchase_date"), "purchase_date not in the calendar")],
    )


def audit_all(raw: dict[str, DataFrame], typed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Audit of every raw table: raw rows = typed rows + audited copies. The category the cleaning
    adds itself is not a raw row."""
    orders = typed["orders"]
    items, payments, reviews = raw["staging_item_orders"], raw["staging_payments"], raw["staging_reviews"]
    no_order = (F.col("_no_order"), "order_id not in final_orders")
    installments = F.coalesce(F.col("num_installments"), F.lit("1")).try_cast("int")
    return {
        "orders": audit_orders(raw["staging_orders"]),
        "sellers": _audit(
            raw["staging_sellers"], ["seller_id"], ["seller_id"], _seller_rules(raw["staging_sellers"])
        ),
        "product_category": _audit(
            raw["staging_product_category"], ["product_category"], ["product_category"],
            _category_rules(raw["staging_product_category"]),
        ),
        "products": _audit(
            raw["staging_products"], ["product_id"], ["product_id"],
            _product_rules(raw["staging_products"], typed["product_category"]),
        ),
        "item_orders": _audit(
            items, ["order_id", "item_id"], [c for c in clean.raw_columns(items) if c != "freight_value"],
            _item_rules(items, orders, typed["sellers"], typed["products"]),
            [
                _lost(F.col("price"), "NULL price"),
                _lost(casts.nonzero_decimal_text("price"), "price zero or too large"),
                _lost(casts.timestamp_to_date("shipping_limit_date"), "shipping_limit_date not in the calendar"),
                _lost(F.col("item_id").try_cast("int"), "Incorrect item_id format"),
            ],
        ),
        "customers": _audit(
            raw["staging_customers"], ["customer_id"], ["customer_id", "customer_unique_id"],
            _customer_rules(raw["staging_customers"], orders),
            [(F.col("_no_order"), "customer_id not in final_orders")],
        ),
        "payments": _audit(
            payments, ["order_id", "payment_sequential"], ["order_id", "payment_value"],
            _payment_rules(payments, orders),
            [
                _lost(F.col("payment_value"), "NULL payment_value"),
                no_order,
                _lost(casts.decimal_text("payment_value"), "payment_value too large"),
                _lost(installments, "Incorrect num_installments format"),
            ],
        ),
        "reviews": _audit(
            reviews, ["review_id", "order_id"], ["review_id", "order_id", "review_score", "post_date"],
            _review_rules(reviews, orders),
            [_lost(casts.timestamp_to_date("post_date"), "post_date not in the calendar")],
        ),
    }
