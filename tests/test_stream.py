"""The request stream: retries, owners of orders, buckets, retention and reset."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF, rows
from ledgerloom.plans import history, online
from ledgerloom.session import materialize_all, new_folder
from ledgerloom.sources import requests as request_source
from ledgerloom.sources import schemas
from ledgerloom.streaming.requests import ONLINE_TABLES, VALID_KEYS, RequestFlow, RequestStore
from ledgerloom.streaming.retries import without_retries
from registry.inputs import Inputs
from test_online import encodings, item, order, pay, table

T0 = datetime(2020, 1, 1)
PAYLOAD = T.StructType().add("request_id", T.StringType()).add("body", T.StringType()).add("ingested_at", T.TimestampType())


def run(stream, sink, checkpoint, **options):
    query = (
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300)
    return query


def test_retries_vanish_and_state_stays_small(spark, tmp_path):
    """100 batches, one a day; each brings new requests and retries of the last days' requests."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = tmp_path / "in"
    source.mkdir()
    sent = []
    for day in range(100):
        at = T0 + timedelta(days=day)
        batch = [(f"r{day}-{i}", "x") for i in range(5)]
        again = sent[-10:]
        sent += batch
        lines = [{"request_id": r, "body": b, "ingested_at": at.isoformat()} for r, b in batch + again]
        (source / f"{day:03d}.json").write_text("\n".join(map(json.dumps, lines)))
    try:
        stream = spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", 1).json(str(source))
        sink = str(tmp_path / "out")
        query = run(without_retries(stream, "3 days"), sink, str(tmp_path / "checkpoint"))
        kept = [r["request_id"] for r in spark.read.schema(PAYLOAD).parquet(sink).collect()]
        assert sorted(kept) == sorted(r for r, _ in sent)
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        # 20 digests are sent in the days of the watermark; of 500 in all the state holds a few days'.
        assert len(state) >= 99 and max(state) <= 60 and max(state[-30:]) <= max(state[:50])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_retries_in_a_table(spark):
    data = [("a", "x", T0 + timedelta(days=2)), ("a", "x", T0), ("a", "y", T0), ("b", "x", None)]
    got = without_retries(spark.createDataFrame(data, PAYLOAD))
    assert rows(got, "request_id", "body") == [("a", "x", T0), ("a", "y", T0)]


def payloads(spark, orders, items, payments):
    return request_source.pack_requests(
        table(spark, "staging_user_orders", orders), table(spark, "staging_user_order_items", items),
        table(spark, "staging_user_payments", payments),
    )


def test_two_requests_on_one_order(spark):
    """The first one owns the order, in bulk and in a stream; each served request has one row."""
    orders = [order("r1"), order("r2", at=T0 + timedelta(days=1)), order("r3", "o3")]
    items = [item("r1"), item("r2", price="99"), item("r3", "o3")]
    payments = [pay("r1"), pay("r2"), pay("r3", "o3")]
    raw = {n: table(spark, n, d) for n, d in zip(schemas.REQUEST_COLUMNS, (orders, items, payments), strict=True)}
    got = online.validate(raw)
    assert rows(got["orders"].select("request_id"), "request_id") == [("r1",), ("r3",)]
    assert rows(got["rejected_user_orders"].select("request_id", "rejected_reason")) == [
        ("r2", "order_id belongs to another request in table staging_user_orders")
    ]
    assert rows(online.order_conflicts(online.valid_orders(raw["staging_user_orders"])).select("request_id", "owner_id")) == [("r2", "r1")]
    passed = online.pass_gate(got)
    base = spark.createDataFrame([], history.online_history(passed["orders"], passed["items"]).schema)
    merged = history.upsert_history(base, history.online_history(passed["orders"], passed["items"]))
    want = online.request_features(passed, encodings(spark), merged)
    assert rows(want.select("request_id", "val_seller_id"), "request_id") == [("r1", "s1"), ("r3", "s1")]

    flow = RequestFlow(RequestStore(spark, new_folder(spark, "requests"), buckets=2), encodings(spark), base)
    for batch, picked in enumerate((["r1"], ["r2", "r3"])):
        part = payloads(spark, *([row for row in rows_ if row[0] in picked] for rows_ in (orders, items, payments)))
        flow.process(part, batch)
    served = flow.store.of_last_batch("features", want.schema)
    assert rows(served.select("request_id", "order_id"), "request_id") == [("r1", "o1"), ("r3", "o3")]
    refused = flow.store.of_last_batch("rejected_user_orders", got["rejected_user_orders"].schema)
    assert {r["request_id"] for r in refused.filter("request_id IS NOT NULL").collect()} == {"r2"}


def test_an_owner_from_before_keeps_its_order(spark):
    orders = online.valid_orders(table(spark, "staging_user_orders", [order("r2"), order("r4", "o4")]))
    known = spark.createDataFrame([("o1", "r9"), ("o8", "r8")], "order_id string, request_id string")
    assert rows(online.order_owners(orders, known), "order_id") == [("o1", "r9"), ("o4", "r4")]


def test_a_batch_reads_the_buckets_of_its_requests(spark):
    store = RequestStore(spark, new_folder(spark, "requests"), buckets=16)
    flow = RequestFlow(store)
    everyone = [f"r{i}" for i in range(200)]
    flow.process(payloads(spark, [order(r, f"o{r}") for r in everyone], [item(r, f"o{r}") for r in everyone], [pay(r, f"o{r}") for r in everyone]), 0)
    schema = table(spark, "staging_user_orders", []).schema
    keys = spark.createDataFrame([("r7",)], "request_id string")
    assert len(store.read("staging_user_orders", schema, keys).inputFiles()) == 1
    assert len(store.read("staging_user_orders", schema).inputFiles()) == 16
    flow.process(payloads(spark, [order("r7", "or7", city="new", at=T0 + timedelta(days=1))], [], []), 1)
    shape = online.valid_orders(table(spark, "staging_user_orders", [])).schema
    now = store.current("valid_orders", shape, ["request_id"])
    assert now.count() == 200 and rows(now.filter("request_id = 'r7'").select("customer_city")) == [("new",)]


def test_compaction_and_repeated_batches_change_nothing(spark):
    x = Inputs(spark, SF)
    raw = x.requests()
    want = online.validate(raw, materialize_all)
    store = RequestStore(spark, new_folder(spark, "requests"), buckets=2, most_folders=2, age_unit=None)
    flow = RequestFlow(store)
    packed = request_source.pack_requests(*raw.values()).withColumn("_part", F.pmod(F.hash(F.coalesce("order.request_id", F.get("items", F.lit(0))["request_id"], F.get("payments", F.lit(0))["request_id"])), F.lit(5)))
    for batch in (0, 1, 2, 3, 4, 4):
        flow.process(packed.filter(F.col("_part") == batch).drop("_part"), batch)
    for name, keys in VALID_KEYS.items():
        got = store.current(f"valid_{name}", want[name].schema, keys)
        assert got.count() == want[name].count() > 0 and got.exceptAll(want[name]).isEmpty()
    staged = store.table("staging_user_orders", raw["staging_user_orders"].schema)
    assert staged.read().filter("request_id IS NOT NULL").count() == raw["staging_user_orders"].count()
    assert len(staged.snapshot().folders) <= 2 * 3


def test_retention_and_reset_of_the_online_tables(spark):
    store = RequestStore(spark, new_folder(spark, "requests"), buckets=2)
    schema = T.StructType.fromDDL("request_id string, ingested_at timestamp")
    old = T.StructType.fromDDL("seller_id string")
    ages = [("a", T0), ("b", T0 + timedelta(days=20)), ("c", None)]
    schemas_ = {n: schema for n in ONLINE_TABLES} | {"rejected_user_orders": schema, "online_history": old}
    for name in schemas_:
        df = spark.createDataFrame([("s",)], old) if name == "online_history" else spark.createDataFrame(ages, schema)
        store.write(df, name, 0)
    store.expire(schemas_, T0 + timedelta(days=30), 14)
    for name in ONLINE_TABLES:
        assert sorted(r["request_id"] for r in store.read(name, schema).collect()) == ["b", "c"]
    assert store.read("rejected_user_orders", schema).count() == 3 and store.read("online_history", old).count() == 1
    store.reset(schemas_)
    assert all(store.read(n, schema).isEmpty() for n in ONLINE_TABLES)
    assert store.read("rejected_user_orders", schema).count() == 3 and store.read("online_history", old).count() == 1
