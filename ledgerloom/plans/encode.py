"""Category-to-integer encodings, fitted once and shared by training and serving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import nulls_last_text
from ledgerloom.operators.ordered import ordered_prefix


def encode_keys(keys: DataFrame, column: str, code: str) -> DataFrame:
    """1-based code of each distinct key in binary text order, NULL last. ``keys`` is distinct."""
    ranked = ordered_prefix(keys.withColumn("_key", nulls_last_text(column)), [], "_key", position="_at")
    return ranked.withColumn(code, (F.col("_at") + 1).cast("int")).drop("_key", "_at")


def encode_category(categories: DataFrame) -> DataFrame:
    return encode_keys(categories, "product_category", "product_category_encoding")


def encode_state(sellers: DataFrame) -> DataFrame:
    return encode_keys(sellers.select("seller_state").distinct(), "seller_state", "state_encoding")


def encode_payment_type(payments: DataFrame) -> DataFrame:
    return encode_keys(payments.select("payment_type").distinct(), "payment_type", "payment_type_encoding")


def encode_all(typed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "category": encode_category(typed["product_category"]),
        "state": encode_state(typed["sellers"]),
        "payment_type": encode_payment_type(typed["payments"]),
    }


def option_lists(encodings: dict[str, DataFrame]) -> DataFrame:
    """Selectable values of each encoded column."""
    parts = (
        ("state", encodings["state"], "seller_state"),
        ("product_category", encodings["category"], "product_category"),
        ("payment_type", encodings["payment_type"], "payment_type"),
    )
    first, second, third = (
        df.select(F.lit(name).alias("option_list"), F.col(column).alias("option_value")) for name, df, column in parts
    )
    return first.unionByName(second).unionByName(third)
