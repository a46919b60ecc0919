"""Guarded text-to-type casts: text outside the accepted pattern, or not castable, is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text patterns. \A and \z anchor the whole text ("$" would also match
# before a final newline).
TIMESTAMP_TEXT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"
DATE_TEXT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DIGITS_TEXT = r"\A[0-9]+\z"
DECIMAL_TEXT = r"\A[0-9]+(\.[0-9]+)?\z"
FRACTION_TEXT = r"\A[0-9]+\.[0-9]+\z"
SCORE_TEXT = r"\A[1-5]\z"

MONEY = "decimal(10,2)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def timestamp_to_date(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.rlike(TIMESTAMP_TEXT), c.try_cast("timestamp_ntz").cast("date"))


def any_date(c: Column | str) -> Column:
    """A bare date or a full timestamp."""
    c = _col(c)
    return F.when(c.rlike(DATE_TEXT), c.try_cast("date")).when(
        c.rlike(TIMESTAMP_TEXT), c.try_cast("timestamp_ntz").cast("date")
    )


def digits_to_int(c: Column | str, pattern: str = DIGITS_TEXT) -> Column:
    c = _col(c)
    return F.when(c.rlike(pattern), c.try_cast("int"))


def decimal_text(c: Column | str) -> Column:
    """Padded number with an optional fraction."""
    c = F.trim(_col(c))
    return F.when(c.rlike(DECIMAL_TEXT), c.try_cast(MONEY))


def nonzero_decimal_text(c: Column | str) -> Column:
    """As ``decimal_text``; a number that is zero before rounding is NULL."""
    c = F.trim(_col(c))
    return F.when(c.rlike(DECIMAL_TEXT) & c.rlike("[1-9]"), c.try_cast(MONEY))


def fraction_text(c: Column | str) -> Column:
    """Unpadded number that must carry a fraction."""
    c = _col(c)
    return F.when(c.rlike(FRACTION_TEXT), c.try_cast(MONEY))


def varchar(c: Column | str, n: int) -> Column:
    """Truncating cast to at most ``n`` characters."""
    return F.left(_col(c), F.lit(n))


def blank_to_null(c: Column | str) -> Column:
    """NULL for text made of white space only; other text is untouched."""
    c = _col(c)
    return F.when(c.rlike(r"\A\s*\z"), F.lit(None)).otherwise(c)
