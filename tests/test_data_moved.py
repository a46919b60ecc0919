"""Stages that must not send the same rows through a shuffle, or write them, more often than needed."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conftest import SF
from ledgerloom.operators.ordered import ordered_prefix
from ledgerloom.plans import checks, clean, items, online, reject
from ledgerloom.session import buckets_of, materialize, materialize_all, materialize_by, new_folder, small
from ledgerloom.streaming.requests import RequestFlow, RequestStore
from registry import spark_queries
from registry.fixtures import dealt_sql
from registry.inputs import Inputs


def test_payload_text_is_compressed_and_requests_are_not_stored_first(spark, monkeypatch):
    folders = []

    def folder(session, label):
        folders.append(real(session, label))
        return folders[-1]

    real = spark_queries.new_folder
    monkeypatch.setattr(spark_queries, "new_folder", folder)
    monkeypatch.setattr(Inputs, "requests", lambda self: (_ for _ in ()).throw(AssertionError("stored")))
    x = Inputs(spark, SF)
    parts = spark_queries._exploded(x)
    files = [f for f in Path(folders[0].removeprefix("file:")).iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    for name, got in parts.items():
        assert got.count() == x.fixture(name).count() > 0


def test_rollups_of_bucketed_items_need_no_exchange(spark):
    x = Inputs(spark, SF)
    joined = spark_queries._joined(x)
    stored = materialize_by("order_id", 3)({"items_joined": joined})["items_joined"]
    got = items.item_order_features(stored)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    want = items.item_order_features(materialize(joined, "items_joined"))
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_items_with_their_category_do_not_meet_the_products_again(spark):
    typed = Inputs(spark, SF).stored(with_reviews=False)
    assert "product_category_name" in typed["item_orders"].columns
    plain = typed["item_orders"].drop("product_category_name")
    category = spark.range(1).select(F.lit("x").alias("product_category"), F.lit("x").alias("product_category_english"), F.lit(1).alias("product_category_encoding"))
    encodings = {"category": category, "state": typed["sellers"].select("seller_state").distinct().withColumn("state_encoding", F.lit(1))}
    a, b = (items.order_items_joined(i, typed["products"], typed["sellers"], encodings) for i in (typed["item_orders"], plain))
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def test_buckets_follow_the_rows_and_small_frames_alone_are_broadcast(spark, monkeypatch):
    assert [buckets_of(n) for n in (0, 1, 200_000, 200_001, 72_000_000)] == [1, 1, 1, 2, 360]
    monkeypatch.setattr("ledgerloom.session.BROADCAST_ROWS", 3)
    hinted = [small(spark.range(n))._jdf.queryExecution().analyzed().toString() for n in (3, 4)]
    assert "broadcast" in hinted[0] and "broadcast" not in hinted[1]


def test_keyed_requests_are_checked_in_their_buckets(spark):
    x = Inputs(spark, SF)
    raw = x.keyed_requests()["staging_user_orders"]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        valid = x.by_request({"valid_orders": online.valid_orders(raw)})["valid_orders"]
        got = online.rejected_orders(raw, valid)
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rows_below_the_order_are_checked_in_their_buckets(spark):
    x = Inputs(spark, SF)
    raw = x.keyed_requests()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = x.by_request({"valid_orders": online.valid_orders(raw["staging_user_orders"])})["valid_orders"]
        valid = online.valid_items(raw["staging_user_order_items"], orders)
        stored = x.by_request({"valid_items": valid})["valid_items"]
        refused = online.rejected_items(raw["staging_user_order_items"], stored)
        for got in (valid, refused):
            assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
            assert got.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_ids_longer_than_the_typed_ones_are_refused_whole(spark):
    """Two raw ids with the same first 50 characters meet in a bucket and stay two ids."""
    long, same = "r" * 50 + "x", "r" * 50
    plain = Inputs(spark, SF).fixture("staging_user_order_items").limit(20).localCheckpoint()
    rows = plain.withColumn("request_id", F.when(F.col("item_id") == "1", long).when(F.col("item_id") == "2", same).otherwise(F.col("request_id")))
    rows = rows.unionByName(rows.limit(1).withColumn("request_id", F.lit(None).cast("string")))
    split = materialize_by(online.TYPED_ID, 3)({"rows": online.split_id(rows)})["rows"]
    raw = online.whole_id(split)
    again = raw.drop(online.TYPED_ID)
    assert again.columns == rows.columns and again.exceptAll(rows).isEmpty() and again.count() == rows.count()
    orders = rows.select(F.left("request_id", F.lit(50)).alias("request_id"), "order_id").dropna().distinct()
    for check in (online.valid_items, lambda r, o: online.rejected_items(r, online.valid_items(r, o))):
        got, want = check(raw, orders), check(rows, orders)
        assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert online.rejected_items(raw, online.valid_items(raw, orders)).filter(F.col("request_id") == long).count() > 0


def test_same_state_order_sends_items_by_product_once(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = spark_queries.QUERIES["same_state_order"](spark, SF)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # The items once; the products by id for their dedupe and after they met their categories.
        assert plan.count("Exchange hashpartitioning(product_id") == 3
        assert got.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_request_rows_go_by_request_before_they_get_their_text(spark):
    x = Inputs(spark, SF)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, exchanges in (("staging_user_order_items", 4), ("staging_user_payments", 2)):
            for buckets in (8, 16):
                got = online.split_id(x.spark.sql(dealt_sql(name, buckets, True))).repartition(buckets, online.TYPED_ID)
                plan = got._jdf.queryExecution().executedPlan().toString()
                # Both sides of the join by part, and both of that by request; none after the text is made.
                assert plan.count("Exchange hashpartitioning") == exchanges
            whole, want = online.whole_id(got).drop(online.TYPED_ID), x.fixture(name)
            assert whole.schema == want.schema and whole.count() == want.count() > 0
            assert whole.exceptAll(want).isEmpty() and want.exceptAll(whole).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_audit_of_raw_rows_dealt_by_order(spark, monkeypatch):
    """Odd ids and copies included, the audit and the typed rows are those of plain raw rows; no row goes by order again."""
    x = Inputs(spark, SF)
    raw = x.raw()
    long, same = "9" * 50 + "x", "9" * 50
    for n in ("staging_orders", "staging_item_orders", "staging_payments", "staging_reviews"):
        rows = raw[n].orderBy("order_id").limit(90)
        odd = rows.limit(12)
        other = F.col(rows.columns[-1])
        changed = F.when(other.isNull(), "x").otherwise(F.lit(None)).alias(rows.columns[-1])
        changed = odd.select(*rows.columns[:-1], changed)
        texts = [odd.withColumn("order_id", F.lit(t).cast("string")) for t in (long, same, None, "")]
        for more in (odd, changed, *texts):
            rows = rows.unionByName(more)
        if n == "staging_item_orders":
            rows = rows.unionByName(odd.withColumn("product_id", F.lit(long)).withColumn("item_id", F.lit("77")))
        raw[n] = rows.localCheckpoint()
    product = raw["staging_products"].limit(1).withColumn("product_id", F.lit(same))
    raw["staging_products"] = raw["staging_products"].unionByName(product).localCheckpoint()
    plain_typed = clean.clean_all(raw, materialize_all, with_category=True)
    plain = reject.audit_all(raw, plain_typed)

    monkeypatch.setattr(Inputs, "raw", lambda self: raw)
    monkeypatch.setattr(Inputs, "products", lambda self: plain_typed["products"])
    keyed, known = x.keyed_raw()
    for n, df in keyed.items():
        back = df.select(*raw[n].columns)
        assert back.count() == raw[n].count() and back.exceptAll(raw[n]).isEmpty()
    typed = clean.clean_all(keyed, x.by_order, with_category=True, known=known)
    for n, df in plain_typed.items():
        got = typed[n].select(*df.columns)
        assert got.count() == df.count() and got.exceptAll(df).isEmpty(), n
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        typed["sellers"] = small(typed["sellers"])
        for n, got in reject.audit_all(keyed, typed).items():
            assert got.columns == plain[n].columns
            assert got.count() == plain[n].count() and got.exceptAll(plain[n]).isEmpty(), n
            if clean.TYPED_ORDER in keyed[f"staging_{n}"].columns:
                assert "Exchange hashpartitioning(_order" not in got._jdf.queryExecution().executedPlan().toString()
                assert "Exchange hashpartitioning(order_id" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_pieces_in_buckets_need_no_exchange_of_their_rows(spark):
    rows = spark.range(900).select((F.col("id") % 2).alias("g"), F.hash("id").alias("k"), F.lit(1).alias("v"))
    args = {"sums": {"before": F.col("v")}, "pieces": 9}
    plain, got = (ordered_prefix(rows, ["g"], "k", bucketed=b, **args) for b in (False, True))
    assert got.count() == plain.count() == 900 and got.exceptAll(plain).isEmpty()
    window = got._jdf.queryExecution().executedPlan().toString().split("Window", 1)[1]
    assert "Exchange" not in window.split("Scan parquet", 1)[0]


def test_payments_are_cleaned_where_they_were_dealt(spark):
    """One exchange of the payments; the query that serves requests stores no joined items."""
    x = Inputs(spark, SF)
    x.buckets = 8
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw, _ = x.keyed_raw(store=False)
        orders = x.by_order({"orders": clean.clean_orders(raw["staging_orders"])})["orders"]
        got = clean.clean_payments(raw["staging_payments"], orders, with_sequence=False).repartition(x.buckets, "order_id")
        assert got.count() == x.payments().count() > 0 and got.exceptAll(x.payments()).isEmpty()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(_order") == 2 and "Exchange hashpartitioning(order_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert set(x.serving_parts) == {"history", "encodings"} and "feature_parts" not in vars(x)


def test_a_year_of_arrivals_is_written_by_several_tasks(spark, monkeypatch):
    folders = {}

    def folder(session, label):
        folders[label] = real(session, label)
        return folders[label]

    real, table = spark_queries.new_folder, Inputs.request_table
    monkeypatch.setattr(spark_queries, "new_folder", folder)
    some = "substring(request_id, 2) % 9 = 0"
    monkeypatch.setattr(Inputs, "request_table", lambda self, name: table(self, name).filter(some).repartition(2))
    got = spark_queries.QUERIES["stream_retries"](spark, SF)
    orders = table(Inputs(spark, SF), "staging_user_orders").filter(some)
    ids = orders.select("request_id").distinct()
    assert got.count() == ids.count() > 0 and got.select("request_id").exceptAll(ids).isEmpty()
    years = spark.read.parquet(folders["arrivals"]).select(F.year("ingested_at")).distinct().count()
    files = [f for f in Path(folders["arrivals"].removeprefix("file:")).iterdir() if f.name.endswith(".parquet")]
    assert len(files) == 2 * years


def test_a_small_file_of_many_rows_is_not_broadcast(spark):
    """Files of zstd ids are far smaller than the rows a broadcast holds in memory."""
    keys = F.concat(F.lit("r"), F.col("id").cast("string")).alias("k")
    few = materialize(spark.range(0, 1_000_000, 1, 1).select(keys, F.lit("x").alias("same")), "few")
    many = materialize(spark.range(0, 1_000_000, 1, 4).select(keys, F.sha2(F.col("id").cast("string"), 256).alias("v")), "many")
    plan = many.join(few, "k", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    tiny = materialize(spark.range(5).select(keys), "tiny")
    assert "BroadcastHashJoin" in many.join(tiny, "k", "left_semi")._jdf.queryExecution().executedPlan().toString()


def test_a_batch_is_checked_in_its_buckets(spark, monkeypatch):
    """The raw rows of a batch are dealt once; typing and dedupe send none of them again. Earlier rows of its requests count."""
    taken = []
    real = online.validate
    monkeypatch.setattr(online, "validate", lambda raw, *more: taken.append(raw) or real(raw, *more))
    x = Inputs(spark, SF)
    raw = {n: df.limit(300).localCheckpoint() for n, df in x.requests().items()}
    odd = {n: df.unionByName(df.limit(1).withColumn("request_id", F.lit(None).cast("string"))) for n, df in raw.items()}
    flow = RequestFlow(RequestStore(spark, new_folder(spark, "requests"), buckets=2, age_unit=None))
    for batch in range(2):
        staged = flow.store.write_all(odd, batch)
        flow.validate(staged, batch)
    for name, df in taken[1].items():
        assert df.drop(online.TYPED_ID).exceptAll(odd[name].unionAll(odd[name])).isEmpty() and df.count() == 2 * odd[name].count()
    plan = online.valid_orders(taken[1]["staging_user_orders"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_online_constraints_are_checked_in_the_buckets_of_requests(spark):
    """Repeated ids, ids that are cut, missing ids and lost parents count as on plain rows."""
    x = Inputs(spark, SF)
    plain = {n.removeprefix("staging_"): x.fixture(n).limit(200).localCheckpoint() for n in ("staging_user_orders", "staging_user_order_items")}
    for name, df in plain.items():
        one = df.limit(1).localCheckpoint()
        odd = [one, *(one.withColumn("request_id", F.lit(i).cast("string")) for i in ("r" * 50 + "x", "r" * 50, None, ""))]
        plain[name] = reduce(DataFrame.unionByName, odd, df)
    plain["user_order_items"] = plain["user_order_items"].unionByName(plain["user_order_items"].limit(1).withColumn("request_id", F.lit("r" * 50 + "z")))
    split = materialize_by(online.TYPED_ID, 3)({n: online.split_id(df) for n, df in plain.items()})
    dealt = {n: online.whole_id(df) for n, df in split.items()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = [(checks.duplicate_keys(t["user_order_items"], "i", ["request_id", "item_id"]),
                    checks.orphans(t["user_order_items"], "i", "request_id", t["user_orders"], "request_id")) for t in (dealt, plain)]
        for got, want in zip(*checked, strict=True):
            assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
            assert got.collect() == want.collect() and got.first()["violations"] > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_online_tables_are_written_from_the_buckets_of_requests(spark, monkeypatch):
    hints = []
    real = DataFrame.hint
    monkeypatch.setattr(DataFrame, "hint", lambda self, name, *more: hints.append(name) or real(self, name, *more))
    monkeypatch.setattr(Inputs, "requests", lambda self: (_ for _ in ()).throw(AssertionError("stored twice")))
    x = Inputs(spark, SF)
    store, shapes = spark_queries._online_tables(x)
    assert "rebalance" not in hints
    for name in ("staging_user_orders", "staging_user_order_items", "staging_user_payments"):
        got, want = store.read(name, shapes[name]).drop("batch"), x.fixture(name)
        assert got.columns == want.columns and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
