"""Raw text tables to typed tables: drop NULL keys, dedupe, cast, check parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import casts
from ledgerloom.operators.dedupe import dedupe_total_order
from ledgerloom.operators.parents import keep_with_parent
from ledgerloom.session import Keep, small, unstored

# Defaults for missing text.
DEFAULT_STATUS = "delivered"
UNKNOWN_CATEGORY = "unknown"
SPLIT_PAYMENT_TYPE = "voucher"
SINGLE_PAYMENT_TYPE = "credit_card"

# Beside the raw rows where they are dealt by order: the typed order id, and the category of a known product.
TYPED_ORDER = "_order"
_ORDER_REST = "_order_rest"
PRODUCT_CATEGORY = "_product_category"
ID_LENGTH = 50


def split_order(raw: DataFrame) -> DataFrame:
    """Raw rows with the typed order id, by which they can be dealt, and the rest of the raw one in place of it.
    Rows without an order id are spread by their content."""
    spread = F.xxhash64(*raw.columns).cast("string")
    rest = F.when(F.col("order_id").isNull(), "").when(F.length("order_id") > ID_LENGTH, F.substr("order_id", F.lit(ID_LENGTH + 1)))
    others = [c for c in raw.columns if c != "order_id"]
    return raw.select(F.coalesce(casts.varchar("order_id", ID_LENGTH), spread).alias(TYPED_ORDER), rest.alias(_ORDER_REST), *others)


def whole_order(split: DataFrame, columns: list[str]) -> DataFrame:
    """The raw rows again in their column order, with the typed order id beside them."""
    rest = F.col(_ORDER_REST)
    whole = F.when(rest.isNull(), F.col(TYPED_ORDER)).when(rest != "", F.concat(TYPED_ORDER, rest)).alias("order_id")
    return split.select(*(whole if c == "order_id" else c for c in columns), TYPED_ORDER)


def with_product_category(items: DataFrame, products: DataFrame) -> DataFrame:
    """Raw items with the category of their product, NULL if it is not known. Products hold each id once."""
    known = products.select(F.col("product_id").alias("_product"), F.col("product_category_name").alias(PRODUCT_CATEGORY))
    found = items.join(known, casts.varchar("product_id", ID_LENGTH) == F.col("_product"), "left")
    return found.select(*items.columns, PRODUCT_CATEGORY)


def raw_columns(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c not in (TYPED_ORDER, PRODUCT_CATEGORY)]


def _order_id(raw: DataFrame) -> Column:
    return F.col(TYPED_ORDER) if TYPED_ORDER in raw.columns else casts.varchar("order_id", ID_LENGTH)


def _dedupe(raw: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Rows dealt by order go nowhere for it; the typed id follows from the raw one and changes no group."""
    dealt = [TYPED_ORDER] if TYPED_ORDER in raw.columns and "order_id" in keys else []
    return dedupe_total_order(raw.na.drop(subset=required), [*dealt, *keys])


def _valid_first(raw: DataFrame, validate_first: bool, condition) -> DataFrame:
    """With ``validate_first`` badly formatted rows go before the dedupe, so that they cannot
    shadow a good row of the same key."""
    return raw.filter(condition) if validate_first else raw


def clean_orders(raw: DataFrame, validate_first: bool = False) -> DataFrame:
    raw = _valid_first(raw, validate_first, casts.timestamp_to_date("purchase_date").isNotNull())
    unique = _dedupe(raw, ["order_id"], ["order_id", "customer_id", "purchase_date"])
    return unique.select(
        _order_id(raw).alias("order_id"),
        casts.varchar("customer_id", 50).alias("customer_id"),
        F.coalesce(casts.varchar("order_status", 25), F.lit(DEFAULT_STATUS)).alias("order_status"),
        *(
            casts.timestamp_to_date(c).alias(c)
            for c in (
                "purchase_date", "order_approval_date", "delivered_carrier_date",
                "delivered_customer_date", "estimated_delivery_date",
            )
        ),
    ).filter(F.col("purchase_date").isNotNull())


def clean_product_category(raw: DataFrame) -> DataFrame:
    unknown = raw.sparkSession.createDataFrame([(UNKNOWN_CATEGORY, UNKNOWN_CATEGORY)], raw.schema)
    return _dedupe(raw.unionByName(unknown), ["product_category"], ["product_category"])


def clean_products(raw: DataFrame, categories: DataFrame) -> DataFrame:
    sizes = [c for c in raw.columns if c not in ("product_id", "product_category_name")]
    typed = _dedupe(raw, ["product_id"], ["product_id"]).select(
        casts.varchar("product_id", 50).alias("product_id"),
        F.coalesce("product_category_name", F.lit(UNKNOWN_CATEGORY)).alias("product_category_name"),
        *(casts.digits_to_int(c).alias(c) for c in sizes),
    )
    return keep_with_parent(typed, "product_category_name", categories, "product_category")


def clean_sellers(raw: DataFrame) -> DataFrame:
    return _dedupe(raw, ["seller_id"], ["seller_id"]).select(
        casts.varchar("seller_id", 50).alias("seller_id"),
        casts.digits_to_int("zip_code").alias("zip_code"),
        casts.varchar("seller_city", 50).alias("seller_city"),
        casts.varchar("seller_state", 3).alias("seller_state"),
    )


def clean_item_orders(
    raw: DataFrame,
    orders: DataFrame,
    sellers: DataFrame,
    products: DataFrame,
    validate_first: bool = False,
    with_category: bool = False,
) -> DataFrame:
    """``with_category=True`` adds the product's category name, so that features need not send the
    items to the products again. Products hold each id once. Raw items that hold the category of their
    product do not meet the products here."""
    raw = _valid_first(
        raw,
        validate_first,
        casts.timestamp_to_date("shipping_limit_date").isNotNull() & casts.nonzero_decimal_text("price").isNotNull(),
    )
    required = [c for c in raw_columns(raw) if c != "freight_value"]
    found = [F.col(PRODUCT_CATEGORY)] if PRODUCT_CATEGORY in raw.columns else []
    typed = (
        _dedupe(raw, ["order_id", "item_id"], required)
        .select(
            _order_id(raw).alias("order_id"),
            F.col("item_id").try_cast("int").alias("item_id"),
            casts.varchar("product_id", 50).alias("product_id"),
            casts.varchar("seller_id", 50).alias("seller_id"),
            casts.timestamp_to_date("shipping_limit_date").alias("shipping_limit_date"),
            casts.nonzero_decimal_text("price").alias("price"),
            casts.fraction_text("freight_value").alias("freight_value"),
            *found,
        )
        .na.drop(subset=["item_id", "shipping_limit_date", "price"])
    )
    typed = keep_with_parent(typed, "seller_id", sellers)
    if found:
        name = F.col(PRODUCT_CATEGORY).alias("product_category_name")
        typed = typed.filter(F.col(PRODUCT_CATEGORY).isNotNull())
        typed = typed.select(*(c for c in typed.columns if c != PRODUCT_CATEGORY), *([name] if with_category else []))
    elif with_category:
        typed = typed.join(products.select("product_id", "product_category_name"), "product_id")
    else:
        typed = keep_with_parent(typed, "product_id", products)
    return keep_with_parent(typed, "order_id", orders)


def clean_customers(raw: DataFrame, orders: DataFrame) -> DataFrame:
    typed = _dedupe(raw, ["customer_id"], ["customer_id", "customer_unique_id"]).select(
        casts.varchar("customer_id", 50).alias("customer_id"),
        casts.varchar("customer_unique_id", 50).alias("customer_unique_id"),
        casts.digits_to_int("zip_code").alias("zip_code"),
        casts.varchar("city", 50).alias("city"),
        casts.varchar("customer_state", 3).alias("customer_state"),
    )
    return keep_with_parent(typed, "customer_id", orders)


def default_payment_type(unique: DataFrame) -> DataFrame:
    """Fill missing payment types: one text for orders with several payment rows, another for
    single ones. Group sizes come from a pre-aggregated count, not from a window."""
    sizes = unique.groupBy("order_id").agg((F.count("*") > 1).alias("_several"))
    default = F.when(F.col("_several"), SPLIT_PAYMENT_TYPE).otherwise(SINGLE_PAYMENT_TYPE)
    joined = unique.join(sizes, "order_id")
    return joined.withColumn("payment_type", F.coalesce("payment_type", default)).select(*unique.columns)


def clean_payments(raw: DataFrame, orders: DataFrame, with_sequence: bool = True) -> DataFrame:
    """``with_sequence=False`` leaves out the renumbered sequence, which features do not use."""
    unique = _dedupe(raw, ["order_id", "payment_sequential"], ["order_id", "payment_value"])
    unique = unique.withColumns(
        {
            "order_id": _order_id(raw),
            "payment_type": casts.varchar("payment_type", 25),
            "num_installments": F.when(F.col("num_installments").isNull(), 1).otherwise(
                F.col("num_installments").try_cast("int")
            ),
            "payment_value": casts.decimal_text("payment_value"),
        }
    )
    typed = default_payment_type(unique)
    columns = ["order_id", "payment_type", "num_installments", "payment_value"]
    if with_sequence:
        # An order has few payments; their numbers are unique after the dedupe.
        inside = Window.partitionBy("order_id").orderBy(F.col("payment_sequential").asc_nulls_last())
        typed = typed.withColumn("payment_sequential", F.row_number().over(inside))
        columns.insert(1, "payment_sequential")
    typed = typed.na.drop(subset=["payment_value", "num_installments"]).select(*columns)
    return keep_with_parent(typed, "order_id", orders)


def clean_reviews(raw: DataFrame, orders: DataFrame) -> DataFrame:
    required = ["review_id", "order_id", "review_score", "post_date"]
    typed = (
        _dedupe(raw, ["review_id", "order_id"], required)
        .select(
            casts.varchar("review_id", 50).alias("review_id"),
            _order_id(raw).alias("order_id"),
            casts.digits_to_int("review_score", casts.SCORE_TEXT).alias("review_score"),
            "comment_title",
            "comment_message",
            casts.timestamp_to_date("post_date").alias("post_date"),
            casts.timestamp_to_date("answer_date").alias("answer_date"),
        )
        .na.drop(subset=["review_score", "post_date"])
    )
    return keep_with_parent(typed, "order_id", orders)


def clean_all(
    raw: dict[str, DataFrame],
    keep: Keep = unstored,
    with_sequence: bool = True,
    with_reviews: bool = True,
    with_category: bool = False,
    known: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All typed tables; ``known`` holds those that are there already. ``keep`` stores tables (for example on shared storage) so that later
    stages read them instead of cleaning again. The purchase-time view needs neither the payment
    sequence nor the reviews."""
    known = known or {}
    categories = known.get("product_category", clean_product_category(raw["staging_product_category"]))
    parents = {
        "orders": clean_orders(raw["staging_orders"]),
        "product_category": categories,
        "products": clean_products(raw["staging_products"], categories),
        "sellers": clean_sellers(raw["staging_sellers"]),
    }
    parents = keep({name: df for name, df in parents.items() if name not in known}) | known
    orders, products, sellers = parents["orders"], parents["products"], parents["sellers"]
    sellers = sellers if keep is unstored else small(sellers)
    children = {
        "item_orders": clean_item_orders(
            raw["staging_item_orders"], orders, sellers, products, with_category=with_category
        ),
        "customers": clean_customers(raw["staging_customers"], orders),
        "payments": clean_payments(raw["staging_payments"], orders, with_sequence),
    }
    if with_reviews:
        children["reviews"] = clean_reviews(raw["staging_reviews"], orders)
    return parents | keep(children)
