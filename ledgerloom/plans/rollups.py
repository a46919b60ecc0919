"""Payment and review features of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import flag, nulls_last_text, ratio


def payment_rollup(payments: DataFrame, encoding: DataFrame) -> DataFrame:
    """Totals and the most used payment type per order; equal counts go to the first type name."""
    by_type = payments.groupBy("order_id", "payment_type").agg(
        F.count("*").alias("payment_type_count"),
        F.sum("num_installments").alias("_installments"),
        F.sum("payment_value").alias("_value"),
    )
    order = F.struct((-F.col("payment_type_count")).alias("n"), nulls_last_text("payment_type").alias("tie"))
    per_order = by_type.groupBy("order_id").agg(
        F.min_by(F.struct("payment_type", "payment_type_count"), order).alias("best"),
        F.sum("_installments").alias("total_installments"),
        F.sum("_value").cast("decimal(12,2)").alias("total_payment_value"),
    )
    return (
        per_order.select("order_id", "best.*", "total_installments", "total_payment_value")
        .join(encoding.withColumnRenamed("payment_type_encoding", "most_freq_payment_type_encoded"),
              "payment_type", "left")
        .select(
            "order_id", "payment_type", "most_freq_payment_type_encoded", "payment_type_count",
            "total_installments", "total_payment_value",
        )
    )


def reviews_asof(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Reviews already posted at the prediction date of their order (the purchase date)."""
    cutoff = orders.select("order_id", F.col("purchase_date").alias("t_pred_date"))
    return reviews.join(cutoff, "order_id").filter("post_date <= t_pred_date")


def review_rollup(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    answered = F.col("answer_date") <= F.col("t_pred_date")
    wait = F.when(answered, F.datediff("answer_date", "post_date")).otherwise(F.datediff("t_pred_date", "post_date"))
    first, last = F.min("post_date"), F.max("post_date")
    return (
        reviews_asof(reviews, orders)
        .groupBy("order_id")
        .agg(
            ratio(F.sum("review_score"), F.count("*")).alias("average_review_score"),
            F.max(flag(F.col("comment_message").isNotNull())).alias("has_review_message"),
            ratio(F.count("comment_message"), F.count("*")).alias("has_message_proportion"),
            flag(F.count("*") > 1).alias("has_multiple_reviews"),
            F.count("*").alias("num_reviews"),
            F.datediff(last, first).alias("review_date_range"),
            first.alias("first_review_date"),
            last.alias("latest_review_date"),
            flag(F.count_if(answered) > 0).alias("has_review_answer"),
            ratio(F.count_if(answered), F.count("*")).alias("received_answer_proportion"),
            F.max(wait).alias("max_answer_time_days"),
            F.min(wait).alias("min_answer_time_days"),
        )
    )
