"""Column lists of the raw text tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Ordered target columns of each raw table.
STAGING_COLUMNS = {
    "staging_customers": ["customer_id", "customer_unique_id", "zip_code", "city", "customer_state"],
    "staging_item_orders": [
        "order_id", "item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value",
    ],
    "staging_payments": ["order_id", "payment_sequential", "payment_type", "num_installments", "payment_value"],
    "staging_reviews": [
        "review_id", "order_id", "review_score", "comment_title", "comment_message", "post_date", "answer_date",
    ],
    "staging_orders": [
        "order_id", "customer_id", "order_status", "purchase_date", "order_approval_date",
        "delivered_carrier_date", "delivered_customer_date", "estimated_delivery_date",
    ],
    "staging_product_category": ["product_category", "product_category_english"],
    "staging_products": [
        "product_id", "product_category_name", "product_name_length", "product_description_length",
        "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    ],
    "staging_sellers": ["seller_id", "zip_code", "seller_city", "seller_state"],
}

# Raw CSV header -> target column.
HEADER_RENAMES = {
    "staging_customers": {"customer_zip_code_prefix": "zip_code", "customer_city": "city"},
    "staging_item_orders": {"order_item_id": "item_id"},
    "staging_payments": {"payment_installments": "num_installments"},
    "staging_reviews": {
        "review_comment_title": "comment_title",
        "review_comment_message": "comment_message",
        "review_creation_date": "post_date",
        "review_answer_timestamp": "answer_date",
    },
    "staging_orders": {
        "order_purchase_timestamp": "purchase_date",
        "order_approved_at": "order_approval_date",
        "order_delivered_carrier_date": "delivered_carrier_date",
        "order_delivered_customer_date": "delivered_customer_date",
        "order_estimated_delivery_date": "estimated_delivery_date",
    },
    "staging_product_category": {
        "product_category_name": "product_category",
        "product_category_name_english": "product_category_english",
    },
    "staging_products": {
        "product_name_lenght": "product_name_length",
        "product_description_lenght": "product_description_length",
    },
    "staging_sellers": {"seller_zip_code_prefix": "zip_code"},
}

# Raw CSV file of each table.
CSV_FILES = {
    "staging_customers": "customers_dataset.csv",
    "staging_item_orders": "order_items_dataset.csv",
    "staging_payments": "order_payments_dataset.csv",
    "staging_reviews": "order_reviews_dataset.csv",
    "staging_orders": "orders_dataset.csv",
    "staging_product_category": "product_category_name_translation.csv",
    "staging_products": "products_dataset.csv",
    "staging_sellers": "sellers_dataset.csv",
}

# Text columns of the request tables, in the order of the payload parts.
REQUEST_COLUMNS = {
    "staging_user_orders": [
        "request_id", "order_id", "customer_id", "customer_unique_id", "customer_zip", "customer_city",
        "customer_state", "order_status", "purchase_date",
    ],
    "staging_user_order_items": [
        "request_id", "order_id", "item_id", "product_id", "seller_id", "shipping_limit_date", "price",
        "freight_value", "product_category_name", "seller_zip", "seller_city", "seller_state",
    ],
    "staging_user_payments": [
        "request_id", "order_id", "payment_sequential", "payment_type", "num_installments", "payment_value",
    ],
}


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def raw_header(table: str) -> list[str]:
    """Header of the raw CSV file of a table."""
    back = {new: old for old, new in HEADER_RENAMES.get(table, {}).items()}
    return [back.get(c, c) for c in STAGING_COLUMNS[table]]


def payload_schema() -> T.StructType:
    """One request: the order row, its item rows and its payment rows, all as text."""
    order, items, payments = (text_schema(c) for c in REQUEST_COLUMNS.values())
    return T.StructType(
        [
            T.StructField("order", order),
            T.StructField("items", T.ArrayType(items)),
            T.StructField("payments", T.ArrayType(payments)),
            T.StructField("ingested_at", T.TimestampType()),
        ]
    )
