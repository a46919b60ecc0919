from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from ledgerloom.plans import checks, clean, encode, features, history, items, reject, rollups, survival
from ledgerloom.sources import schemas, tables
from registry.inputs import Inputs

D = date


def table(spark, name, data):
    return spark.createDataFrame(data, schemas.text_schema(schemas.STAGING_COLUMNS[name]))


def order(order_id, purchase="2020-01-01 00:00:00", customer=None, status="delivered", delivered="2020-01-05 00:00:00"):
    return (order_id, customer or f"c{order_id}", status, purchase, None, None, delivered, "2020-01-10 00:00:00")


def test_clean_orders_rules(spark):
    raw = table(spark, "staging_orders", [
        order("1", status=None), order(None), order("2", purchase="soon"), order("3", purchase="2020-02-30 00:00:00"),
        # The smaller customer id wins the key although its date is bad.
        order("4", customer="a", purchase="bad"), order("4", customer="b"),
    ])
    assert rows(clean.clean_orders(raw).select("order_id", "order_status")) == [("1", "delivered")]
    assert rows(clean.clean_orders(raw, validate_first=True).select("order_id", "customer_id"), "order_id") == [("1", "c1"), ("4", "b")]
    refused = rows(reject.rejected_orders(raw).select("rejected_reason"), "rejected_reason")
    assert refused == [("Incorrect purchase_date format",), ("Incorrect purchase_date format",), ("NULL order_id",)]
    audit = rows(reject.audit_orders(raw).select("order_id", "customer_id", "rejected_reason"), "order_id", "customer_id")
    assert (("3", "c3", "purchase_date not in the calendar") in audit) and (("4", "b", "duplicate order_id") in audit)
    assert len(audit) == 5


def test_category_named_unknown_is_kept_once(spark):
    raw = table(spark, "staging_product_category", [("unknown", "zzz"), ("toys", "toys"), (None, "x")])
    assert rows(clean.clean_product_category(raw), "product_category") == [("toys", "toys"), ("unknown", "unknown")]


def test_payments_default_type_and_sequence(spark):
    orders = clean.clean_orders(table(spark, "staging_orders", [order("1"), order("2")]))
    raw = table(spark, "staging_payments", [
        ("1", "7", None, None, " 10.5 "), ("1", "9", "boleto", "2", "bad"), ("2", "1", None, "x", "1"), ("2", None, None, "3", "2"),
        ("3", "1", "boleto", "1", "1"),
    ])
    got = rows(clean.clean_payments(raw, orders), "order_id", "payment_sequential")
    assert got == [("1", 1, "voucher", 1, Decimal("10.50")), ("2", 2, "voucher", 3, Decimal("2.00"))]
    reasons = rows(reject.rejected_payments(raw, orders).select("order_id", "rejected_reason"), "order_id")
    assert reasons == [("1", "Incorrect payment_value format"), ("3", None)]


def joined(spark, data):
    schema = (
        "order_id string, item_id int, product_id string, shipping_limit_date date, price decimal(10,2), "
        "freight_value decimal(10,2), product_category_name string, product_category string, "
        "product_category_english string, product_category_encoding int, seller_id string, zip_code int, "
        "seller_city string, seller_state string, state_encoding int"
    )
    out = []
    for o, i, price, freight, cat, seller, state in data:
        money = [None if m is None else Decimal(m) for m in (price, freight)]
        out.append((o, i, f"p{i}", D(2020, 1, i), *money, cat, cat, cat, 1, seller, 1, "x", state, 1))
    return spark.createDataFrame(out, schema)


def test_item_features_edges(spark):
    df = joined(spark, [
        ("single", 1, "5", "1", "a", "s1", "SP"),
        # Equal price: the row without freight ranks first.
        ("ties", 1, "9", "3", "a", "s1", "SP"), ("ties", 2, "9", None, "b", "s2", "RJ"),
        ("nocat", 1, "1", "1", None, "s1", "SP"), ("nocat", 2, "2", "1", None, "s1", "SP"), ("nocat", 3, "9", "9", "a", "s2", "SP"),
    ])
    got = {r["order_id"]: r for r in items.item_order_features(df).collect()}
    assert got["single"]["price_std"] == 0.0 and got["single"]["price_range"] == 0
    assert got["single"]["max_freight_ratio"] == got["single"]["min_freight_ratio"] == 0.2
    assert got["ties"]["most_exp_product_id"] == "p2" and got["ties"]["most_exp_freight"] is None
    # One item each: higher price, then missing freight first, decides; an unknown value is most valuable.
    assert got["ties"]["most_freq_category"] == "b" and got["ties"]["val_seller_id"] == "s2"
    assert got["ties"]["has_multiple_seller_states"] == 1
    # Missing categories count as one category.
    assert got["nocat"]["most_freq_category"] is None and got["nocat"]["num_distinct_categories"] == 2
    assert got["nocat"]["has_duplicate_sellers"] == 0 and got["nocat"]["num_distinct_sellers"] == 2


def test_ranks_show_ties(spark):
    df = joined(spark, [("o", 1, "5", "1", "a", "s1", "SP"), ("o", 2, "5", "1", "b", "s2", "SP")])
    assert rows(items.ranked_category(df).select("tiebreak_rank")) == [(1,), (1,)]
    assert rows(items.ranked_seller(df).select("tiebreak_rank")) == [(1,), (1,)]
    assert rows(items.top_category(df).select("most_freq_category", "most_freq_cat_concentration")) == [("a", 0.5)]


def history_rows(spark, data):
    schema = "order_id string, seller_id string, cutoff_date date, order_seller_price decimal(12,2), order_seller_freight decimal(12,2), num_order_items int"
    return spark.createDataFrame([(o, s, d, Decimal(p), f and Decimal(f), n) for o, s, d, p, f, n in data], schema)


def test_seller_history(spark):
    df = history_rows(spark, [
        ("a", "s", D(2020, 1, 1), "10", "1", 1), ("b", "s", D(2020, 1, 1), "20", None, 2), ("c", "s", D(2020, 1, 2), "30", "3", 3),
        ("d", "t", D(2020, 1, 1), "5", "5", 1),
    ])
    got = rows(history.seller_history_to_date(df), "order_id")
    assert got == [("a", "s", 0.0, 0.0, 0, 0), ("b", "s", 10.0, 1.0, 1, 1), ("c", "s", 15.0, 1.0, 2, 3), ("d", "t", 0.0, 0.0, 0, 0)]
    earlier = rows(history.seller_history_to_date(df, strictly_before_day=True), "order_id")
    assert earlier[1] == ("b", "s", 0.0, 0.0, 0, 0) and earlier[2] == ("c", "s", 15.0, 1.0, 2, 3)


def test_history_upsert_keeps_source(spark):
    orders = spark.createDataFrame([("r1", "a", D(2020, 1, 5))], "request_id string, order_id string, purchase_date date")
    lines = spark.createDataFrame(
        [("r1", "a", "s", Decimal("7.00"), Decimal("1.00"))],
        "request_id string, order_id string, seller_id string, price decimal(10,2), freight_value decimal(10,2)",
    )
    base = history.seller_history_base(lines.drop("request_id"), orders.drop("request_id"))
    merged = history.upsert_history(base, history.online_history(orders, lines))
    row = merged.first()
    assert merged.count() == 1 and (row["source_type"], row["request_id"]) == ("offline", "r1") and row["created_at"]


def typed_orders(spark, data):
    raw = table(spark, "staging_orders", data)
    return clean.clean_orders(raw)


def test_order_targets_and_null_person(spark):
    orders = typed_orders(spark, [
        order("1", "2020-01-01 00:00:00"), order("2", "2020-01-01 00:00:00"), order("3", "2020-03-01 00:00:00"),
        order("4", "2020-01-01 00:00:00"), order("5", "2020-02-01 00:00:00"),
    ])
    customers = clean.clean_customers(
        table(spark, "staging_customers", [(f"c{i}", "p", "1", "x", "SP") for i in (1, 2, 3)]), orders
    )
    targets = features.order_targets(orders, customers)
    got = rows(targets.select("order_id", "total_purchases_by_customer", "second_purchase_date"), "order_id")
    assert got == [
        ("1", 3, D(2020, 1, 1)), ("2", 3, D(2020, 3, 1)), ("3", 3, None), ("4", 2, D(2020, 2, 1)), ("5", 2, None)
    ]
    # Orders without a person are one group.
    assert rows(features.first_order_per_customer(targets).select("order_id"), "order_id") == [("1",), ("4",)]
    labels = targets.select("order_id", *(c.alias(n) for n, c in features.survival_labels().items()))
    assert rows(labels, "order_id")[2] == ("3", 1, None, 0)


def test_reviews_after_purchase_are_ignored(spark):
    orders = typed_orders(spark, [order("1", "2020-01-10 00:00:00")])
    reviews = clean.clean_reviews(table(spark, "staging_reviews", [
        ("a", "1", "5", None, "m", "2020-01-05 00:00:00", "2020-01-20 00:00:00"),
        ("b", "1", "3", None, None, "2020-01-07 00:00:00", "2020-01-08 00:00:00"),
        ("c", "1", "1", None, None, "2020-02-01 00:00:00", None), ("d", "1", "6", None, None, "2020-01-01 00:00:00", None),
    ]), orders)
    row = rollups.review_rollup(reviews, orders).first()
    assert (row["num_reviews"], row["average_review_score"], row["has_review_answer"]) == (2, 4.0, 1)
    assert (row["max_answer_time_days"], row["min_answer_time_days"], row["received_answer_proportion"]) == (5, 1, 0.5)


def test_encodings_put_null_last(spark):
    sellers = spark.createDataFrame([("1", "SP"), ("2", None), ("3", "AC"), ("4", "SP")], "seller_id string, seller_state string")
    assert rows(encode.encode_state(sellers), "state_encoding") == [("AC", 1), ("SP", 2), (None, 3)]


def test_constraints_hold_on_typed_tables(spark):
    typed = clean.clean_all(Inputs(spark, SF).raw())
    assert checks.constraint_violations(typed).filter("violations > 0").collect() == []


def test_wide_table_invariants(spark):
    x = Inputs(spark, SF)
    typed = x.stored()
    wide = features.wide_from_typed(typed)
    people = wide.groupBy("customer_unique_id").count()
    assert people.filter("count > 1").count() == 0 and people.count() > 50
    view = features.view_from_typed(typed)
    assert view.columns == features.PURCHASE_TIME_COLUMNS and len(view.columns) == 52
    assert len(features.trainable(view).columns) == 34
    assert view.exceptAll(wide.select(*features.PURCHASE_TIME_COLUMNS)).count() == 0


def test_later_orders_do_not_change_features(spark):
    """With fixed encodings, orders after the cutoff change no feature of orders before it."""
    x = Inputs(spark, SF)
    typed = x.stored()
    cutoff = D(1997, 1, 1)
    early = {**typed, "orders": typed["orders"].filter(F.col("purchase_date") <= F.lit(cutoff))}
    for name in ("item_orders", "payments", "reviews"):
        early[name] = typed[name].join(early["orders"].select("order_id"), "order_id", "left_semi").select(*typed[name].columns)
    codes = encode.encode_all(typed)

    def view(tables_):
        base = history.seller_history_base(tables_["item_orders"], tables_["orders"])
        lines = items.order_items_joined(tables_["item_orders"], tables_["products"], tables_["sellers"], codes)
        return features.purchase_time_view(
            features.order_targets(tables_["orders"], tables_["customers"]),
            rollups.payment_rollup(tables_["payments"], codes["payment_type"]),
            items.item_order_features(lines),
            history.seller_history_to_date(base),
        ).drop("has_second_purchase", "days_until_second_purchase").filter(F.col("purchase_date") <= F.lit(cutoff))

    a, b = view(typed), view(early)
    assert a.count() == b.count() > 10
    assert a.exceptAll(b).count() == 0


def survival_frame(spark, n_event, n_censored):
    data = [(f"e{i:04d}", D(2020, 1, 1 + i % 20), 1, 10 + i % 50) for i in range(n_event)]
    data += [(f"c{i:04d}", D(2020, 1, 1 + i % 20), 0, None) for i in range(n_censored)]
    return spark.createDataFrame(data, "id string, t_pred_date date, has_second_purchase int, days_until_second_purchase int")


def test_split_sizes_equal_the_floors(spark):
    df = survival.censor_durations(survival_frame(spark, 37, 101), D(2020, 1, 10))
    split = survival.split_temporal_stratified(df, "id")
    got = {(r["has_second_purchase"], r["split"]): r["count"] for r in split.groupBy("has_second_purchase", "split").count().collect()}
    for event, n in ((1, 37), (0, 101)):
        kept = int(n * 0.8)
        train = int(kept * (7 / 8))
        assert got[event, "train"] == train and got[event, "validation"] == kept - train and got[event, "test"] == n - kept
    latest = split.groupBy("has_second_purchase", "split").agg(F.min("t_pred_date").alias("a"), F.max("t_pred_date").alias("b"))
    ends = {(r[0], r[1]): (r["a"], r["b"]) for r in latest.collect()}
    assert ends[0, "train"][1] <= ends[0, "validation"][0] and ends[0, "validation"][1] <= ends[0, "test"][0]
    # Rows that start after the study end get a negative duration.
    assert df.filter("has_second_purchase = 0 AND t_pred_date > '2020-01-10' AND days_until_second_purchase >= 0").count() == 0


def test_folds_and_permutation(spark):
    df = survival.censor_durations(survival_frame(spark, 40, 60))
    folds = survival.stratified_folds(df, "id", 5).groupBy("has_second_purchase", "fold").count()
    assert {r["count"] for r in folds.collect()} == {8, 12}
    swapped = survival.permute_column(df, "id", "days_until_second_purchase", 1, 0)
    assert sorted(rows(swapped.select("days_until_second_purchase"))) == sorted(rows(df.select("days_until_second_purchase")))
    assert rows(swapped, "id") != rows(df, "id")
    other = survival.permute_column(df.repartition(5), "id", "days_until_second_purchase", 1, 0)
    assert rows(other, "id") == rows(swapped, "id")


def test_kaplan_meier(spark):
    data = [(1, 1), (2, 0), (2, 1), (4, 1)]
    df = spark.createDataFrame(data, "days_until_second_purchase int, has_second_purchase int")
    got = survival.kaplan_meier(df).orderBy("duration").collect()
    assert [r["at_risk"] for r in got] == [4, 3, 1]
    assert [r["survival"] for r in got] == pytest.approx([0.75, 0.5, 0.0])
    assert [r["cumulative_hazard"] for r in got] == pytest.approx([0.25, 0.25 + 1 / 3, 0.25 + 1 / 3 + 1])


def test_person_period(spark):
    df = spark.createDataFrame([("a", 1, 61), ("b", 0, 30), ("c", 1, 0)], "id string, has_second_purchase int, days_until_second_purchase int")
    got = rows(survival.person_period(df, 30).select("id", "period", "period_event"), "id", "period")
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("b", 0, 0), ("c", 0, 1)]
    assert survival.negative_durations(df).count() == 0
    short = rows(survival.person_period(df, 30, horizon=60).select("id", "period", "period_event"), "id", "period")
    assert short == [("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("c", 0, 1)]


def test_headers(spark, tmp_path):
    folder = str(tmp_path / "raw.csv")
    raw = spark.createDataFrame([("c1", "p1", "010", "a \"q\"\nb", None)], "customer_id string, customer_unique_id string, customer_zip_code_prefix string, customer_city string, customer_state string")
    raw.withColumn("extra", F.lit(1)).write.csv(folder, header=True, escape='"')
    got = tables.align_headers(tables.scan_csv(spark, folder), "staging_customers")
    assert rows(got) == [("c1", "p1", "010", "a \"q\"\nb", None)]
    with pytest.raises(ValueError, match="zip_code"):
        tables.align_headers(raw.drop("customer_zip_code_prefix"), "staging_customers")
    with pytest.raises(Exception, match="(?i)path"):
        tables.scan_csv(spark, str(tmp_path / "missing.csv"))


def test_pages(spark):
    df = spark.range(95).select(F.format_string("%03d", "id").alias("k"))
    pages = [rows(tables.page(df.repartition(4), "k", 40, n), "k") for n in (0, 40, 80, 120)]
    assert [len(p) for p in pages] == [40, 40, 15, 0] and pages[1][0] == ("040",)
