"""Number and ordering expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; NULL where the denominator is zero or NULL."""
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(num.cast("double"), den.cast("double"))


def flag(condition: Column) -> Column:
    """1 where the condition is true, else 0 (also for NULL)."""
    return F.when(condition, 1).otherwise(0)


def nulls_last_text(c: Column | str) -> Column:
    """Text whose plain ascending order equals that of ``c`` with NULL at the end."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("0"), c), F.lit("1"))
