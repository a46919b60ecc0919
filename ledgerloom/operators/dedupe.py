"""Keep one row per key.

``row_number() = 1`` is planned with a group limit on the map side, so a key that holds a
large share of the rows sends at most one row per map task through the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key under ``order``; NULL keys form one group."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def dedupe_total_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First row of each key by all other columns, ascending with NULL last.

    The order is total, so the result does not depend on partitioning.
    """
    rest = [c for c in df.columns if c not in keys]
    return first_per_key(df, keys, [F.col(c).asc_nulls_last() for c in rest])


def dedupe_latest(df: DataFrame, keys: Sequence[str], version: str = "ingested_at") -> DataFrame:
    """Newest row of each key; ties are broken by all other columns."""
    rest = [c for c in df.columns if c not in keys and c != version]
    order = [F.col(version).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in rest)]
    return first_per_key(df, keys, order)
