"""Membership tests against parent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_with_parent(df: DataFrame, column: str, parent: DataFrame, parent_column: str | None = None) -> DataFrame:
    """Rows whose ``column`` is a key of the parent (``IN``)."""
    keys = parent.select(F.col(parent_column or column).alias(column))
    return df.join(keys, column, "left_semi").select(*df.columns)


def mark_missing(df: DataFrame, column: str, parent: DataFrame, flag: str, parent_column: str | None = None) -> DataFrame:
    """Add the value of ``column NOT IN parent keys``: NULL where the column is NULL.

    Repeated parent keys count once, so no row of ``df`` is multiplied; NULL keys match nothing.
    """
    keys = parent.select(F.col(parent_column or column).alias(column)).dropna().distinct().withColumn(flag, F.lit(True))
    value = F.when(F.col(column).isNotNull(), F.col(flag).isNull())
    return df.join(keys, column, "left").select(*df.columns, value.alias(flag))
