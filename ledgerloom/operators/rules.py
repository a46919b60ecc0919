"""Ordered reject rules: which rows are refused, and the first reason that applies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (condition, reason). A rule without a reason refuses the row but names no cause.
Rule = tuple[Column, "Column | str | None"]


def first_reason(rules: Sequence[Rule], default: Column | None = None) -> Column:
    named = [(c, F.lit(r) if isinstance(r, str) else r) for c, r in rules if r is not None]
    reason = reduce(lambda acc, rule: acc.when(*rule), named[1:], F.when(*named[0]))
    return reason if default is None else reason.otherwise(default)


def any_rule(rules: Sequence[Rule]) -> Column:
    return reduce(or_, (c for c, _ in rules))


def refused(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.filter(any_rule(rules)).withColumn("rejected_reason", first_reason(rules))
