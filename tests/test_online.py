from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF, rows
from ledgerloom.plans import history, online
from ledgerloom.session import new_folder
from ledgerloom.sources import requests as request_source
from ledgerloom.sources import schemas
from ledgerloom.streaming.requests import VALID_KEYS, RequestFlow, RequestStore
from registry.inputs import Inputs

T1, T2 = datetime(2020, 1, 1), datetime(2020, 1, 2)


def table(spark, name, data):
    ddl = ", ".join(f"{c} string" for c in schemas.REQUEST_COLUMNS[name]) + ", ingested_at timestamp"
    return spark.createDataFrame(data, ddl)


def order(request="r1", order_id="o1", zip_="10", day="2020-01-01", at=T1, city="x", person="p"):
    return (request, order_id, "c", person, zip_, city, "SP", None, day, at)


def item(request="r1", order_id="o1", number="1", seller="s1", price="10", freight="1", category="toys", at=T1):
    return (request, order_id, number, "p1", seller, "2020-01-03", price, freight, category, "10", "x", "SP", at)


def pay(request="r1", order_id="o1", number="1", kind=None, installments="1", value="11", at=T1):
    return (request, order_id, number, kind, installments, value, at)


def checked(spark, orders, items, payments):
    return online.validate(
        {
            "staging_user_orders": table(spark, "staging_user_orders", orders),
            "staging_user_order_items": table(spark, "staging_user_order_items", items),
            "staging_user_payments": table(spark, "staging_user_payments", payments),
        }
    )


def test_latest_valid_order_wins(spark):
    got = checked(spark, [order(), order(city="new", at=T2), order(day="bad", at=datetime(2020, 1, 3))], [item()], [pay()])
    # The newest retry is invalid and ignored while an older one is valid.
    assert rows(got["orders"].select("customer_city", "order_status", "purchase_date")) == [("new", "created", date(2020, 1, 1))]
    assert got["rejected_user_orders"].count() == 0


def test_reasons(spark):
    got = checked(
        spark,
        [order("r1"), order("r2", "o2", zip_="1x"), order("r3", None), order("r4", "o4", day="2020-02-30")],
        [
            item("r1", number="x"), item("r1", number=None), item("r1", number="2", seller=None),
            item("r1", number="3", price=" 1,5"), item("r1", number="4", freight=None), item("r2", "o2"), item("r1", "", "9"),
        ],
        [pay("r1", installments="many"), pay("r1", number="2", value=None), pay("r2", "o2")],
    )
    assert rows(got["rejected_user_orders"].select("request_id", "rejected_reason"), "request_id") == [
        ("r2", "Invalid customer_zip in table staging_user_orders"),
        ("r3", "NULL order_id in table staging_user_orders"),
        ("r4", "Unknown validation error in table staging_user_orders"),
    ]
    suffix = "in table staging_user_order_items"
    assert {r[0] for r in rows(got["rejected_user_order_items"].select("rejected_reason"))} == {
        f"Invalid item_id {suffix}, item_id x", f"Invalid item_id {suffix}, item_id NULL", f"NULL seller_id {suffix}, item_id 2",
        f"Invalid price {suffix}, item_id 3", f"Invalid freight_value {suffix}, item_id 4",
        f"Unknown validation error {suffix}, item_id 1", f"Empty order_id {suffix}",
    }
    suffix = "in table staging_user_payments"
    assert {r[0] for r in rows(got["rejected_user_payments"].select("rejected_reason"))} == {
        f"Invalid num_installments {suffix}, payment_sequential 1", f"Invalid payment_value {suffix}, payment_sequential 2",
        f"Unknown validation error {suffix}, payment_sequential 1",
    }


def test_gate(spark):
    got = checked(spark, [order("r1"), order("r2", "o2")], [item("r1"), item("r2", "o2", number="x")], [pay("r1"), pay("r2", "o2")])
    seen = spark.createDataFrame([("r1",), ("r2",)], "request_id string")
    gate = rows(online.rejected_gate(got, seen), "request_id")
    assert gate == [("r1", 0, 0, 0, 0, False), ("r2", 0, 0, 1, 1, True)]
    passed = online.pass_gate(got)
    assert [rows(passed[n].select("request_id")) for n in ("orders", "items", "payments")] == [[("r1",)]] * 3


def test_order_belongs_to_one_request(spark):
    orders = [order("r2", at=T2), order("r1"), order("r3", "o3")]
    complete = online.valid_orders(table(spark, "staging_user_orders", orders))
    assert rows(online.order_conflicts(complete).select("request_id", "owner_id")) == [("r2", "r1")]
    # Validation refuses the rows of the late request.
    assert rows(checked(spark, orders, [], [])["orders"].select("request_id"), "request_id") == [("r1",), ("r3",)]


def encodings(spark):
    return {
        "category": spark.createDataFrame([("toys", "toys", 1)], "product_category string, product_category_english string, product_category_encoding int"),
        "state": spark.createDataFrame([("SP", 1), (None, 2)], "seller_state string, state_encoding int"),
        "payment_type": spark.createDataFrame([("credit_card", 1)], "payment_type string, payment_type_encoding int"),
    }


def test_request_features(spark):
    got = checked(
        spark, [order("r1"), order("r2", "o2", day="2020-01-05")],
        [item("r1", price="10.01"), item("r1", number="2", price="10.02"), item("r1", number="3", price="10.02"), item("r2", "o2", category="unseen")],
        [pay("r1"), pay("r2", "o2")],
    )
    passed = online.pass_gate(got)
    orders = spark.createDataFrame([("o0", date(2019, 1, 1))], "order_id string, purchase_date date")
    old = spark.createDataFrame([("o0", "s1", Decimal("4.00"), Decimal("2.00"))], "order_id string, seller_id string, price decimal(10,2), freight_value decimal(10,2)")
    merged = history.upsert_history(history.seller_history_base(old, orders), history.online_history(passed["orders"], passed["items"]))
    full = online.request_features(passed, encodings(spark), merged)
    by_request = {r["request_id"]: r for r in full.collect()}
    # A request sees earlier rows of its seller, not itself.
    assert by_request["r1"]["seller_order_volume"] == 1 and by_request["r1"]["avg_seller_price"] == 4.0
    assert by_request["r2"]["seller_order_volume"] == 2 and by_request["r2"]["seller_item_volume"] == 4
    assert rows(online.complete_features(full).select("request_id")) == [("r1",)]
    assert rows(online.refused_features(full)) == [("r2", "NULL most_exp_prod_category")]
    typed = online.request_features(passed, encodings(spark), merged, typed=True).filter("request_id = 'r1'").first()
    assert typed["avg_price"] == Decimal("10.02") and round(by_request["r1"]["avg_price"], 6) == 10.016667


def test_payload_round_trip(spark):
    x = Inputs(spark, SF)
    raw = x.requests()
    folder = new_folder(spark, "payloads")
    request_source.pack_requests(*raw.values()).write.json(folder)
    parts = request_source.explode_requests(request_source.read_requests(spark, folder))
    for name, df in raw.items():
        back = parts[name].filter("request_id IS NOT NULL")
        assert back.count() == df.count() and back.exceptAll(df.select(*back.columns)).count() == 0


def test_stream_equals_batch(spark):
    x = Inputs(spark, SF)
    raw = x.requests()
    source = new_folder(spark, "payloads")
    request_source.pack_requests(*raw.values()).repartition(4).write.json(source)
    # The requests cover years; folders by day suit a store of two weeks.
    store = RequestStore(spark, new_folder(spark, "requests"), age_unit=None)
    flow = RequestFlow(store)
    checkpoint = new_folder(spark, "stream-checkpoint")
    for _ in range(2):  # the second start finds nothing new and changes nothing
        run = flow.start(request_source.stream_requests(spark, source, files_per_batch=2), checkpoint)
        assert run.awaitTermination(300)
    want = online.validate(raw)
    assert store.read("staging_user_orders", raw["staging_user_orders"].schema).select("batch").distinct().count() == 2
    for name, keys in VALID_KEYS.items():
        got = store.current(f"valid_{name}", want[name].schema, keys)
        assert got.count() == want[name].count() > 0
        assert got.exceptAll(want[name]).count() == 0
    for name in online.REJECTED_TABLES:
        now = store.of_last_batch(name, want[name].schema).filter("request_id IS NOT NULL")
        assert now.exceptAll(want[name]).count() == 0 and now.count() == want[name].count()
    # A batch that is processed again overwrites itself.
    first = store.read("staging_user_orders", raw["staging_user_orders"].schema)
    before = first.count()
    flow.ingest(request_source.read_requests(spark, source).limit(0), 99)
    assert store.read("staging_user_orders", raw["staging_user_orders"].schema).count() == before
    kept = store.retained("staging_user_orders", raw["staging_user_orders"].schema, F.lit(datetime(2001, 6, 1)), 14)
    assert 0 < kept.count() < before
