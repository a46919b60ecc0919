"""Seller history: one row per (order, seller), and the totals before each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import ratio
from ledgerloom.operators.ordered import ordered_prefix
from ledgerloom.operators.upsert import upsert_by_key
from ledgerloom.session import materialize, small

AMOUNT = "decimal(12,2)"
UPDATED_ON_CONFLICT = [
    "request_id", "cutoff_date", "order_seller_price", "order_seller_freight", "num_order_items",
]


def _per_seller(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys, "seller_id").agg(
        F.sum("price").cast(AMOUNT).alias("order_seller_price"),
        F.sum("freight_value").cast(AMOUNT).alias("order_seller_freight"),
        F.count("*").cast("int").alias("num_order_items"),
    )


def _history_columns(df: DataFrame, source: str, request_id: Column, created_at: Column) -> DataFrame:
    return df.select(
        F.lit(source).alias("source_type"),
        request_id.cast("string").alias("request_id"),
        "order_id",
        "seller_id",
        F.col("purchase_date").alias("cutoff_date"),
        "order_seller_price",
        "order_seller_freight",
        "num_order_items",
        created_at.cast("timestamp_ntz").alias("created_at"),
    )


def seller_history_base(items: DataFrame, orders: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Items are summed per (order, seller) before they meet the orders, so the join moves one
    row per pair and not one per item."""
    joined = _per_seller(items, ["order_id"]).join(orders.select("order_id", "purchase_date"), "order_id")
    return _history_columns(joined, "offline", F.lit(None), F.current_timestamp() if as_of is None else as_of)


def online_history(orders: DataFrame, items: DataFrame) -> DataFrame:
    keys = ["request_id", "order_id"]
    joined = _per_seller(items, keys).join(orders.select(*keys, "purchase_date"), keys)
    return _history_columns(joined, "online", F.col("request_id"), F.lit(None))


def of_sellers(rows: DataFrame, sellers: DataFrame) -> DataFrame:
    """History rows of the given sellers."""
    return rows.join(sellers.select("seller_id").distinct(), "seller_id", "left_semi").select(*rows.columns)


def stored_sellers(rows: DataFrame) -> DataFrame:
    """The sellers of the rows, to be broadcast if they are few; history in buckets then stays there."""
    return small(materialize(rows.select("seller_id").distinct(), "sellers"))


def upsert_history(base: DataFrame, online: DataFrame) -> DataFrame:
    """On a known (order, seller) the source and creation time keep their values."""
    return upsert_by_key(base, online, ["order_id", "seller_id"], UPDATED_ON_CONFLICT)


def seller_history_to_date(history: DataFrame, strictly_before_day: bool = False) -> DataFrame:
    """Averages and volumes of the seller's rows before each row, by (date, order). The history
    should be a stored table: it is read several times.

    ``strictly_before_day=True`` leaves out other orders of the same day.
    """
    if strictly_before_day:
        totals = _before_day(history)
    else:
        # Only what the sums need goes through the range exchange.
        values = {
            "_price": F.col("order_seller_price"),
            "_priced": F.col("order_seller_price").isNotNull().cast("int"),
            "_freight": F.col("order_seller_freight"),
            "_freighted": F.col("order_seller_freight").isNotNull().cast("int"),
            "_items": F.col("num_order_items"),
        }
        keyed = history.select(
            "order_id",
            "seller_id",
            F.concat(F.col("cutoff_date").cast("string"), "order_id").alias("_key"),
            *(value.alias(name) for name, value in values.items()),
        )
        totals = ordered_prefix(
            keyed,
            ["seller_id"],
            "_key",
            {name: F.col(name) for name in values},
            position="seller_order_volume",
            store=False,
            bucketed=True,
        )
    return totals.select(
        "order_id",
        "seller_id",
        F.coalesce(ratio("_price", "_priced"), F.lit(0.0)).alias("avg_seller_price"),
        F.coalesce(ratio("_freight", "_freighted"), F.lit(0.0)).alias("avg_seller_freight"),
        F.col("seller_order_volume").cast("long").alias("seller_order_volume"),
        F.coalesce(F.col("_items"), F.lit(0)).cast("long").alias("seller_item_volume"),
    )


def _before_day(history: DataFrame) -> DataFrame:
    """Totals over earlier days. Days are summed first, so a window sees one row per day."""
    daily = history.groupBy("seller_id", "cutoff_date").agg(
        F.sum("order_seller_price").alias("p"),
        F.count("order_seller_price").alias("pn"),
        F.sum("order_seller_freight").alias("f"),
        F.count("order_seller_freight").alias("fn"),
        F.sum("num_order_items").alias("i"),
        F.count("*").alias("n"),
    )
    earlier = Window.partitionBy("seller_id").orderBy("cutoff_date").rowsBetween(Window.unboundedPreceding, -1)
    names = {"p": "_price", "pn": "_priced", "f": "_freight", "fn": "_freighted", "i": "_items"}
    before = daily.select(
        "seller_id",
        "cutoff_date",
        *(F.sum(c).over(earlier).alias(name) for c, name in names.items()),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("seller_order_volume"),
    )
    return history.join(before, ["seller_id", "cutoff_date"])
