"""Features of the items of an order.

Every rollup is a plain grouped aggregate with partial sums before the shuffle. "Best row"
picks use ``max_by`` over an ordering struct inside the same aggregates, so no group is ever
sorted or collected in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import flag, nulls_last_text, ratio

CATEGORY = ["product_category", "product_category_encoding"]
SELLER = ["seller_id", "zip_code", "seller_city", "seller_state", "state_encoding"]


def with_sellers(
    items: DataFrame, sellers: DataFrame, states: DataFrame, sized: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """Items with the attributes and the encoded state of their sellers."""
    known = states.filter("seller_state IS NOT NULL")
    return items.join(sized(sellers.join(known, "seller_state", "left")), "seller_id", "left")


def order_items_joined(
    items: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    encodings: dict[str, DataFrame],
    sized: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Items with product, category and seller attributes. Without ``sized`` (see ``session.small``) sellers and
    categories are joined without hints: the adaptive engine broadcasts those whose measured size is
    small. Items that already hold their category name do not meet the products again."""

    def encoded(rows: DataFrame) -> DataFrame:
        categories = sized(encodings["category"].withColumnRenamed("product_category", "_cat"))
        return rows.join(categories, F.col("product_category_name") == F.col("_cat"), "left").withColumnRenamed(
            "_cat", "product_category"
        )

    if "product_category_name" in items.columns:
        with_product = encoded(items)
    else:
        product_rows = encoded(products.select("product_id", "product_category_name"))
        with_product = items.join(product_rows, "product_id", "left")
    return with_sellers(with_product, sellers, encodings["state"], sized).select(
        "order_id", "item_id", "product_id", "shipping_limit_date", "price", "freight_value",
        "product_category_name", "product_category", "product_category_english", "product_category_encoding",
        *SELLER,
    )


def online_items_joined(items: DataFrame, encodings: dict[str, DataFrame]) -> DataFrame:
    """The same row set for request items, which carry their seller and category attributes."""
    states = encodings["state"].filter("seller_state IS NOT NULL")
    categories = encodings["category"].withColumnRenamed("product_category", "_cat")
    return (
        items.withColumnRenamed("seller_zip", "zip_code")
        .join(states, "seller_state", "left")
        .join(categories, F.col("product_category_name") == F.col("_cat"), "left")
        .withColumnRenamed("_cat", "product_category")
        .select(
            "order_id", "item_id", "product_id", "shipping_limit_date", "price", "freight_value",
            "product_category_name", "product_category", "product_category_english", "product_category_encoding",
            *SELLER,
        )
    )


def _descending(*columns: str) -> list[Column]:
    """Order struct fields for a descending sort with NULL first: structs put NULL lowest, and
    the smallest negated value is the largest value."""
    return [(-F.col(c)).alias(f"_{c}") for c in columns]


def _most_expensive() -> Column:
    """Equal price and freight: the smallest item number."""
    columns = F.struct("product_id", "seller_id", "price", "freight_value", *CATEGORY)
    return F.min_by(columns, F.struct(*_descending("price", "freight_value"), "item_id"))


def most_expensive_item(joined: DataFrame) -> DataFrame:
    best = joined.groupBy("order_id").agg(_most_expensive().alias("best"))
    return best.select("order_id", "best.*")


def distinct_seller_states(joined: DataFrame) -> DataFrame:
    counted = joined.groupBy("order_id").agg(F.count_distinct("seller_state").alias("num_seller_states"))
    return counted.withColumn("has_multiple_seller_states", flag(F.col("num_seller_states") > 1))


def freight_ratio_bounds(joined: DataFrame) -> DataFrame:
    return joined.groupBy("order_id").agg(*_ratio_bounds())


def _ratio_bounds() -> list[Column]:
    share = ratio("freight_value", "price")
    return [F.max(share).alias("max_freight_ratio"), F.min(share).alias("min_freight_ratio")]


def _rollup() -> list[Column]:
    freight, merch = F.sum("freight_value"), F.sum("price")
    first, last = F.min("shipping_limit_date"), F.max("shipping_limit_date")
    return [
        F.count("*").alias("num_items_in_order"),
        freight.cast("decimal(12,2)").alias("total_freight_value"),
        merch.cast("decimal(12,2)").alias("total_merch_value"),
        (freight + merch).cast("decimal(12,2)").alias("total_order_value"),
        ratio(merch, F.count("price")).alias("avg_price"),
        F.coalesce(F.stddev_samp(F.col("price").cast("double")), F.lit(0.0)).alias("price_std"),
        F.min("price").alias("min_price"),
        (F.max("price") - F.min("price")).cast("decimal(10,2)").alias("price_range"),
        ratio(freight, merch).alias("freight_price_ratio"),
        *_ratio_bounds(),
        last.alias("latest_shipping_limit_date"),
        F.datediff(last, first).alias("shipping_window_days"),
    ]


def order_rollup(joined: DataFrame) -> DataFrame:
    return joined.groupBy("order_id").agg(*_rollup())


def category_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("order_id", *CATEGORY).agg(
        F.count("*").alias("cat_count"),
        F.sum("price").alias("total_price"),
        F.sum("freight_value").alias("total_freight"),
    )


def ranked_category(joined: DataFrame) -> DataFrame:
    """Every (order, category) with its rank. An order holds at most as many rows here as there
    are categories, because items are summed per category first."""
    counts = category_counts(joined)
    order = Window.partitionBy("order_id")
    rank = order.orderBy(
        F.col("cat_count").desc(), F.col("total_price").desc_nulls_first(), F.col("total_freight").desc_nulls_first()
    )
    return counts.withColumns(
        {
            "num_distinct_categories": F.count("*").over(order),
            "most_freq_cat_concentration": ratio(F.col("cat_count"), F.sum("cat_count").over(order)),
            "tiebreak_rank": F.rank().over(rank),
        }
    )


def top_category(joined: DataFrame) -> DataFrame:
    """Most frequent category per order; equal ranks go to the first category name."""
    order = F.struct(
        *_descending("cat_count", "total_price", "total_freight"), nulls_last_text("product_category").alias("tie")
    )
    top = category_counts(joined).groupBy("order_id").agg(
        F.count("*").alias("num_distinct_categories"),
        F.sum("cat_count").alias("_items"),
        F.min_by(F.struct(*CATEGORY, "cat_count"), order).alias("best"),
    )
    return top.select(
        "order_id",
        F.col("best.product_category").alias("most_freq_category"),
        F.col("best.product_category_encoding").alias("most_freq_encoded_category"),
        "num_distinct_categories",
        ratio(F.col("best.cat_count"), F.col("_items")).alias("most_freq_cat_concentration"),
    )


def seller_value_per_order(joined: DataFrame) -> DataFrame:
    """One row per (order, seller) with the seller's value in the order."""
    grouped = joined.groupBy("order_id", *SELLER).agg(
        (F.sum("price") + F.sum("freight_value")).cast("decimal(12,2)").alias("total_value"),
        flag(F.count("*") > 1).alias("has_duplicate_sellers"),
    )
    sellers = grouped.groupBy("order_id").agg(F.count("seller_id").alias("num_distinct_sellers"))
    return grouped.join(sellers, "order_id").withColumn(
        "has_multiple_sellers", flag(F.col("num_distinct_sellers") > 1)
    )


def ranked_seller(joined: DataFrame) -> DataFrame:
    window = Window.partitionBy("order_id").orderBy(F.col("total_value").desc_nulls_first())
    return seller_value_per_order(joined).withColumn("tiebreak_rank", F.rank().over(window))


def top_seller(joined: DataFrame) -> DataFrame:
    """Most valuable seller per order (an unknown value ranks highest); equal values go to the
    first seller id. The states of all sellers are counted in the same aggregate."""
    grouped = joined.groupBy("order_id", *SELLER).agg(
        (F.sum("price") + F.sum("freight_value")).alias("total_value"),
        flag(F.count("*") > 1).alias("has_duplicate_sellers"),
    )
    order = F.struct(*_descending("total_value"), *SELLER)
    top = grouped.groupBy("order_id").agg(
        F.count("seller_id").alias("num_distinct_sellers"),
        F.count_distinct("seller_state").alias("num_seller_states"),
        F.min_by(F.struct(*SELLER, "has_duplicate_sellers"), order).alias("best"),
    )
    return top.select(
        "order_id",
        flag(F.col("num_seller_states") > 1).alias("has_multiple_seller_states"),
        "num_seller_states",
        F.col("best.seller_id").alias("val_seller_id"),
        F.col("best.zip_code").alias("val_seller_zip"),
        F.col("best.seller_city").alias("val_seller_city"),
        F.col("best.seller_state").alias("val_seller_state"),
        F.col("best.state_encoding").alias("val_seller_encoded_state"),
        F.col("best.has_duplicate_sellers").alias("has_duplicate_sellers"),
        flag(F.col("num_distinct_sellers") > 1).alias("has_multiple_sellers"),
        "num_distinct_sellers",
    )


def item_order_features(joined: DataFrame) -> DataFrame:
    """All item features of an order: one aggregate over the items, one over their categories and
    one over their sellers, joined on the grouping key without a further shuffle."""
    rolled = joined.groupBy("order_id").agg(*_rollup(), _most_expensive().alias("_best"))
    rolled = rolled.select(
        "*",
        F.col("_best.product_id").alias("most_exp_product_id"),
        F.col("_best.price").alias("most_exp_price"),
        F.col("_best.freight_value").alias("most_exp_freight"),
        F.col("_best.product_category").alias("most_exp_prod_category"),
        F.col("_best.product_category_encoding").alias("most_exp_encoded_category"),
    ).drop("_best")
    return rolled.join(top_category(joined), "order_id").join(top_seller(joined), "order_id")
