"""Keyed upsert, retention and reset as table-to-table functions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_by_key(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Target rows with matching updates applied, plus new rows.

    Without ``update_columns`` the update rows of a key replace all target rows of it; with the
    request as the only key that also removes stale rows of a resubmitted request. With
    ``update_columns`` only those columns change on a match, the others keep the target value, and
    ``updates`` holds each key once. Columns missing from ``updates`` are NULL in new rows.
    """
    if update_columns is None:
        kept = target.join(updates.select(*keys), list(keys), "left_anti")
        return kept.select(*target.columns).unionByName(updates, allowMissingColumns=True).select(*target.columns)
    both = target.withColumn("_old", F.lit(True)).alias("t").join(
        updates.withColumn("_new", F.lit(True)).alias("u"), list(keys), "full"
    )

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in updates.columns:
            return F.col(f"t.{c}").alias(c)
        changed = F.col("_new") if c in update_columns else F.col("_old").isNull()
        return F.when(changed, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return both.select(*(pick(c) for c in target.columns))


def keep_recent(df: DataFrame, as_of: Column | datetime, retention_days: int = 14, age: str = "ingested_at") -> DataFrame:
    """Rows not older than the retention; rows of unknown age stay."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    oldest = moment - F.make_dt_interval(F.lit(retention_days))
    return df.filter(F.col(age).isNull() | (F.col(age) >= oldest))


def emptied(df: DataFrame) -> DataFrame:
    """Empty table of the same schema."""
    return df.sparkSession.createDataFrame([], df.schema)
