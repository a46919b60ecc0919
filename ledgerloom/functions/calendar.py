"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(later, earlier)


def day_of_week(c: Column | str) -> Column:
    """0 is Sunday, 6 is Saturday."""
    return F.dayofweek(c) - 1


def on_weekend(c: Column | str) -> Column:
    return F.when(day_of_week(c).isin(0, 6), 1).otherwise(0)
