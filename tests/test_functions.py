from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from conftest import rows
from ledgerloom.functions import calendar, casts, curves
from ledgerloom.functions.numbers import ratio


def one(spark, values, expression, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_dates(spark):
    texts = ["1995-02-28 10:00:00", "1995-02-30 00:00:00", "1995-02-28", "1995-02-28 10:00:00\n", "soon", None]
    assert one(spark, texts, casts.timestamp_to_date("v")) == [date(1995, 2, 28), None, None, None, None, None]
    assert one(spark, texts, casts.any_date("v")) == [date(1995, 2, 28), None, date(1995, 2, 28), None, None, None]


def test_numbers(spark):
    assert one(spark, ["12", "12\n", "2.0", "-1", " 3", "99999999999", None], casts.digits_to_int("v")) == [12] + [None] * 6
    decimals = ["10", " 10.505 ", "1.", ".5", "0", "0.001", "123456789.00", None]
    plain = [None if x is None else str(x) for x in one(spark, decimals, casts.decimal_text("v"))]
    assert plain == ["10.00", "10.51", None, None, "0.00", "0.00", None, None]
    nonzero = [None if x is None else str(x) for x in one(spark, decimals, casts.nonzero_decimal_text("v"))]
    assert nonzero == ["10.00", "10.51", None, None, None, "0.00", None, None]
    strict = [None if x is None else str(x) for x in one(spark, ["12", "12.5", " 12.5"], casts.fraction_text("v"))]
    assert strict == [None, "12.50", None]


def test_text(spark):
    assert one(spark, ["abcdef", "ab", None], casts.varchar("v", 3)) == ["abc", "ab", None]
    assert one(spark, ["", "  \t", " a ", None], casts.blank_to_null("v")) == [None, None, " a ", None]


def test_calendar(spark):
    days = [date(2023, 1, 1), date(2023, 1, 2), date(2023, 1, 7)]
    assert one(spark, days, calendar.day_of_week("v"), "v date") == [0, 1, 6]
    assert one(spark, days, calendar.on_weekend("v"), "v date") == [1, 0, 1]


def test_ratio_guards_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [0.5, None, None]


def test_curves(spark):
    data = [([10.0, 20.0, 40.0], [0.9, 0.5, 0.2]), ([10.0, 20.0], [0.9, 0.8]), ([10.0], [0.4]), ([], [])]
    df = spark.createDataFrame(data, "t array<double>, s array<double>")
    got = df.select(
        curves.median_time(F.col("t"), F.col("s")),
        curves.restricted_mean(F.col("t"), F.col("s")),
        curves.restricted_mean(F.col("t"), F.col("s"), from_zero_step=True),
    )
    assert [tuple(round(x, 6) if x is not None else None for x in r) for r in got.collect()] == [
        (20.0, 14.0, 29.0), (None, 8.5, 19.0), (10.0, 0.0, 10.0), (None, 0.0, 0.0)
    ]


def test_survival_from_hazards(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.2],)], "h array<double>")
    row = df.select(curves.survival_from_hazards(F.col("h")), curves.total_cumulative_hazard(F.col("h"))).first()
    assert [round(x, 9) for x in row[0]] == [0.5, 0.25, 0.2]
    assert round(row[1], 9) == 0.5 + 1.0 + 1.2
    assert all(a >= b for a, b in zip(row[0], row[0][1:]))


def test_rows_helper(spark):
    assert rows(spark.range(3), F.col("id").desc()) == [(2,), (1,), (0,)]
