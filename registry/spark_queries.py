"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import casts
from ledgerloom.operators import concordance as conc
from ledgerloom.operators import parents, upsert
from ledgerloom.operators.dedupe import dedupe_latest, dedupe_total_order
from ledgerloom.operators.ordered import pieces_of
from ledgerloom.plans import checks, clean, encode, features, history, items, models, online, reject, rollups, survival
from ledgerloom.session import materialize, materialize_all, new_folder, small
from ledgerloom.sources import requests as request_source
from ledgerloom.sources import schemas, tables
from ledgerloom.sources.stored import StoredTable
from ledgerloom.streaming.requests import VALID_KEYS, RequestFlow, RequestStore
from ledgerloom.streaming.retries import without_retries
from registry.inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

AS_OF = datetime(2001, 6, 1)
MODEL_COLUMNS = ["avg_price", "num_items_in_order", "absent_feature", "seller_order_volume", "val_seller_encoded_state"]


def tidy(df: DataFrame) -> DataFrame:
    """Engine-neutral result types: decimals as double, dates and times as text, flags as int."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: tidy(fn(Inputs(spark, sf_dir)))
    return fn


# ---- sources and sinks --------------------------------------------------------------------


def _raw_csv(x: Inputs, table: str) -> str:
    df = x.fixture(table)
    folder = new_folder(x.spark, "csv")
    df.toDF(*schemas.raw_header(table)).write.csv(folder, header=True, escape='"')
    return folder


@query
def scan_csv_staging(x: Inputs) -> DataFrame:
    return tables.scan_csv(x.spark, _raw_csv(x, "staging_orders"))


@query
def align_headers(x: Inputs) -> DataFrame:
    return tables.align_headers(tables.scan_csv(x.spark, _raw_csv(x, "staging_reviews")), "staging_reviews")


@query
def append_and_rebuild(x: Inputs) -> DataFrame:
    path = new_folder(x.spark, "orders")
    typed = x.orders()
    tables.rebuild_table(typed.filter("order_status = 'delivered'"), path)
    tables.append_table(typed.filter("order_status <> 'delivered'"), path)
    return x.spark.read.schema(typed.schema).parquet(path)


@query
def param_query(x: Inputs) -> DataFrame:
    return tables.query_with_params(
        x.fixture("staging_user_order_items"),
        "SELECT * FROM {source} WHERE seller_state = :state AND ingested_at >= :since",
        {"state": "S3", "since": datetime(2001, 3, 1)},
    )


@query
def paged_scan(x: Inputs) -> DataFrame:
    return tables.page(x.orders(), "order_id", limit=500, offset=2000)


def _exploded(x: Inputs) -> dict[str, DataFrame]:
    """Packing reads each request table once, so none is stored first; the payload text is compressed."""
    raw = {name: x.fixture(name) for name in schemas.REQUEST_COLUMNS}
    path = new_folder(x.spark, "payloads")
    request_source.pack_requests(*raw.values()).write.option("compression", "gzip").json(path)
    parts = request_source.explode_requests(request_source.read_requests(x.spark, path))
    return {name: df.filter("request_id IS NOT NULL") for name, df in parts.items()}


@query
def explode_requests(x: Inputs) -> DataFrame:
    return _exploded(x)["staging_user_order_items"]


@query
def explode_request_orders(x: Inputs) -> DataFrame:
    return _exploded(x)["staging_user_orders"]


@query
def explode_request_payments(x: Inputs) -> DataFrame:
    return _exploded(x)["staging_user_payments"]


@query
def sanitize_blanks(x: Inputs) -> DataFrame:
    padded = x.spark.sql(
        "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '   ' WHEN c_custkey % 7 = 0 THEN '' "
        "ELSE ' ' || c_mktsegment END AS segment FROM customer"
    )
    return request_source.sanitize_blanks(padded, ["segment"])


def _encodings(x: Inputs) -> dict[str, DataFrame]:
    return encode.encode_all({"product_category": x.categories(), "sellers": x.sellers(), "payments": x.payments()})


@query
def option_lists(x: Inputs) -> DataFrame:
    return encode.option_lists(_encodings(x))


# ---- casts, filters and dedupe ------------------------------------------------------------


@query
def cast_ts_date(x: Inputs) -> DataFrame:
    raw = x.fixture("staging_orders")
    dates = [c for c in raw.columns if c.endswith("_date")]
    return raw.select("customer_id", *(casts.timestamp_to_date(c).alias(c) for c in dates))


@query
def cast_date_two_formats(x: Inputs) -> DataFrame:
    raw = x.fixture("staging_user_orders")
    return raw.select("request_id", "ingested_at", casts.any_date("purchase_date").alias("purchase_date"))


@query
def cast_int_guarded(x: Inputs) -> DataFrame:
    raw = x.fixture("staging_products")
    return raw.select(
        "product_id", *(casts.digits_to_int(c).alias(c) for c in ("product_photos_qty", "product_weight_g"))
    )


@query
def cast_decimal_guarded(x: Inputs) -> DataFrame:
    raw = x.fixture("staging_item_orders")
    return raw.select("order_id", "item_id", "product_id", casts.decimal_text("price").alias("price"))


@query
def cast_price_nonzero(x: Inputs) -> DataFrame:
    raw = x.fixture("staging_item_orders")
    return raw.select("order_id", "item_id", "product_id", casts.nonzero_decimal_text("price").alias("price"))


@query
def cast_freight_strict(x: Inputs) -> DataFrame:
    raw = x.fixture("staging_item_orders")
    return raw.select("order_id", "item_id", "product_id", casts.fraction_text("freight_value").alias("freight_value"))


@query
def varchar_truncate(x: Inputs) -> DataFrame:
    return x.spark.table("part").select(
        "p_partkey", casts.varchar("p_name", 6).alias("name"), casts.varchar("p_type", 3).alias("type")
    )


@query
def payment_type_default(x: Inputs) -> DataFrame:
    raw = x.fixture("staging_payments").na.drop(subset=["order_id", "payment_value"])
    return clean.default_payment_type(dedupe_total_order(raw, ["order_id", "payment_sequential"]))


@query
def reject_reason_first_match(x: Inputs) -> DataFrame:
    lost = reject.rejected_item_orders(x.fixture("staging_item_orders"), x.orders(), x.sellers(), x.products())
    return lost.groupBy("rejected_reason").agg(F.count("*").alias("rejected_rows"))


@query
def dedupe_first_total_order(x: Inputs) -> DataFrame:
    return dedupe_total_order(x.fixture("staging_item_orders"), ["order_id", "item_id"])


@query
def dedupe_latest_wins(x: Inputs) -> DataFrame:
    return dedupe_latest(x.fixture("staging_user_order_items"), ["request_id", "item_id"])


# ---- cleaning and rejects -----------------------------------------------------------------


@query
def clean_orders(x: Inputs) -> DataFrame:
    return x.orders()


@query
def clean_product_category(x: Inputs) -> DataFrame:
    return x.categories()


@query
def clean_products(x: Inputs) -> DataFrame:
    return x.products()


@query
def clean_sellers(x: Inputs) -> DataFrame:
    return x.sellers()


@query
def clean_item_orders(x: Inputs) -> DataFrame:
    return x.items()


@query
def clean_customers(x: Inputs) -> DataFrame:
    return x.customers()


@query
def clean_payments(x: Inputs) -> DataFrame:
    return x.payments(with_sequence=True)


@query
def clean_reviews(x: Inputs) -> DataFrame:
    return x.reviews()


@query
def rejected_orders(x: Inputs) -> DataFrame:
    return reject.rejected_orders(x.fixture("staging_orders"))


@query
def rejected_sellers(x: Inputs) -> DataFrame:
    return reject.rejected_sellers(x.fixture("staging_sellers"))


@query
def rejected_product_category(x: Inputs) -> DataFrame:
    return reject.rejected_product_category(x.fixture("staging_product_category"))


@query
def rejected_products(x: Inputs) -> DataFrame:
    return reject.rejected_products(x.fixture("staging_products"), x.categories())


@query
def rejected_item_orders(x: Inputs) -> DataFrame:
    return reject.rejected_item_orders(x.fixture("staging_item_orders"), x.orders(), x.sellers(), x.products())


@query
def rejected_customers(x: Inputs) -> DataFrame:
    return reject.rejected_customers(x.fixture("staging_customers"), x.orders())


@query
def rejected_payments(x: Inputs) -> DataFrame:
    return reject.rejected_payments(x.fixture("staging_payments"), x.orders())


@query
def rejected_reviews(x: Inputs) -> DataFrame:
    return reject.rejected_reviews(x.fixture("staging_reviews"), x.orders())


@query
def audit_orders(x: Inputs) -> DataFrame:
    return reject.audit_orders(x.fixture("staging_orders"))


@query
def audit_totals(x: Inputs) -> DataFrame:
    raw, known = x.keyed_raw()
    typed = clean.clean_all(raw, x.by_order, with_sequence=False, known=known)
    typed["sellers"] = small(typed["sellers"])
    audits = reject.audit_all(raw, typed)
    parts = []
    for name, audit in audits.items():
        totals = audit.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("dropped_rows"))
        kept = typed[name].filter("product_category <> 'unknown'") if name == "product_category" else typed[name]
        parts.append(totals.select(F.lit(name).alias("table_name"), "dropped_rows", F.lit(0).cast("long").alias("typed_rows")))
        parts.append(kept.agg(F.count("*").alias("typed_rows")).select(
            F.lit(name).alias("table_name"), F.lit(0).cast("long").alias("dropped_rows"), "typed_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table_name").agg(F.sum("dropped_rows").alias("dropped_rows"), F.sum("typed_rows").alias("typed_rows"))


@query
def constraint_violations(x: Inputs) -> DataFrame:
    raw = {name.removeprefix("staging_"): df for name, df in x.raw().items()}
    return checks.constraint_violations(raw)


# ---- joins --------------------------------------------------------------------------------


@query
def semi_join_parents(x: Inputs) -> DataFrame:
    return parents.keep_with_parent(x.fixture("staging_item_orders"), "order_id", x.orders())


@query
def anti_join_not_in(x: Inputs) -> DataFrame:
    marked = parents.mark_missing(x.fixture("staging_item_orders"), "product_id", x.products(), "missing")
    return marked.filter("missing").drop("missing")


@query
def anti_join_left_null(x: Inputs) -> DataFrame:
    raw = x.fixture("staging_user_orders")
    return raw.join(online.valid_orders(raw).select("request_id"), "request_id", "left_anti")


def _joined(x: Inputs) -> DataFrame:
    encodings = {"category": encode.encode_category(x.categories()), "state": encode.encode_state(x.sellers())}
    return items.order_items_joined(x.items(), x.products(), x.sellers(), encodings)


@query
def order_items_joined(x: Inputs) -> DataFrame:
    return _joined(x)


@query
def reviews_asof(x: Inputs) -> DataFrame:
    return rollups.reviews_asof(x.reviews(), x.orders())


@query
def order_targets(x: Inputs) -> DataFrame:
    return features.order_targets(x.orders(), x.customers())


# ---- encodings, rollups and ranks ---------------------------------------------------------


@query
def encode_category(x: Inputs) -> DataFrame:
    return encode.encode_category(x.categories())


@query
def encode_state(x: Inputs) -> DataFrame:
    return encode.encode_state(x.sellers())


@query
def encode_payment_type(x: Inputs) -> DataFrame:
    return encode.encode_payment_type(x.payments())


@query
def seller_history_base(x: Inputs) -> DataFrame:
    return history.seller_history_base(x.items(), x.orders()).drop("created_at")


@query
def seller_history_to_date(x: Inputs) -> DataFrame:
    base = materialize(history.seller_history_base(x.items(), x.orders()), "history")
    return history.seller_history_to_date(base)


@query
def seller_history_before_day(x: Inputs) -> DataFrame:
    base = materialize(history.seller_history_base(x.items(), x.orders()), "history")
    return history.seller_history_to_date(base, strictly_before_day=True)


@query
def payment_rollup(x: Inputs) -> DataFrame:
    payments = materialize(x.payments(), "payments")
    return rollups.payment_rollup(payments, encode.encode_payment_type(payments))


@query
def review_rollup(x: Inputs) -> DataFrame:
    return rollups.review_rollup(x.reviews(), x.orders())


@query
def distinct_seller_states(x: Inputs) -> DataFrame:
    return items.distinct_seller_states(_joined(x))


@query
def category_counts(x: Inputs) -> DataFrame:
    return items.category_counts(_joined(x))


@query
def seller_value_per_order(x: Inputs) -> DataFrame:
    return items.seller_value_per_order(_joined(x))


@query
def order_rollup(x: Inputs) -> DataFrame:
    return rounded(items.order_rollup(_joined(x)), "price_std")


@query
def most_expensive_item(x: Inputs) -> DataFrame:
    return items.most_expensive_item(_joined(x))


@query
def freight_ratio_bounds(x: Inputs) -> DataFrame:
    return items.freight_ratio_bounds(_joined(x))


@query
def ranked_category(x: Inputs) -> DataFrame:
    return items.ranked_category(_joined(x))


@query
def ranked_seller(x: Inputs) -> DataFrame:
    return items.ranked_seller(_joined(x))


@query
def item_order_features(x: Inputs) -> DataFrame:
    return rounded(items.item_order_features(x.by_order({"items_joined": _joined(x)})["items_joined"]), "price_std")


# ---- feature tables -----------------------------------------------------------------------


@query
def calendar_features(x: Inputs) -> DataFrame:
    return x.orders().select("order_id", *(c.alias(n) for n, c in features.calendar_features().items()))


@query
def survival_labels(x: Inputs) -> DataFrame:
    targets = features.order_targets(x.orders(), x.customers())
    return targets.select("order_id", *(c.alias(n) for n, c in features.survival_labels().items()))


@query
def delivery_features(x: Inputs) -> DataFrame:
    latest = x.items().groupBy("order_id").agg(F.max("shipping_limit_date").alias("latest_shipping_limit_date"))
    rows = features.order_targets(x.orders(), x.customers()).join(latest, "order_id")
    return rows.select("order_id", *(c.alias(n) for n, c in features.delivery_features().items()))


@query
def review_timing_features(x: Inputs) -> DataFrame:
    orders = materialize(x.orders(), "orders")
    reviews = clean.clean_reviews(x.fixture("staging_reviews"), orders)
    customers = clean.clean_customers(x.fixture("staging_customers"), orders)
    rows = features.order_targets(orders, customers).join(rollups.review_rollup(reviews, orders), "order_id", "left")
    return rows.select("order_id", *(c.alias(n) for n, c in features.review_timing_features().items()))


@query
def same_state_order(x: Inputs) -> DataFrame:
    orders, sellers = materialize(x.orders(), "orders"), materialize(x.sellers(), "sellers")
    customers = clean.clean_customers(x.fixture("staging_customers"), orders)
    typed = clean.clean_item_orders(x.fixture("staging_item_orders"), orders, small(sellers), x.products())
    # The seller of an order takes no product columns.
    top = items.top_seller(items.with_sellers(typed, sellers, encode.encode_state(sellers), small))
    rows = features.order_targets(orders, customers).join(top, "order_id")
    return rows.select("order_id", "val_seller_id", features.same_state_order().alias("same_state_order"))


@query
def first_order_per_customer(x: Inputs) -> DataFrame:
    return features.first_order_per_customer(features.order_targets(x.orders(), x.customers()))


@query
def customer_features_wide(x: Inputs) -> DataFrame:
    return rounded(features.wide_from_typed(x.stored(), x.by_order), "price_std")


VIEW_PARTS = ("targets", "payments", "item_features", "history_to_date")


def _view(x: Inputs) -> DataFrame:
    return features.purchase_time_view(*(x.feature_parts[n] for n in VIEW_PARTS))


@query
def purchase_time_view(x: Inputs) -> DataFrame:
    return rounded(_view(x), "price_std")


@query
def trainable_projection(x: Inputs) -> DataFrame:
    return rounded(features.trainable(_view(x)), "price_std")


@query
def align_to_model(x: Inputs) -> DataFrame:
    return models.align_to_model(_view(x), MODEL_COLUMNS, ["order_id"])


# ---- requests -----------------------------------------------------------------------------


@query
def online_orders_valid(x: Inputs) -> DataFrame:
    return online.valid_orders(x.request_table("staging_user_orders"))


@query
def online_orders_rejected(x: Inputs) -> DataFrame:
    raw = x.request_table("staging_user_orders")
    return online.rejected_orders(raw, online.valid_orders(raw))


def _checked(x: Inputs, raw: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    return online.validate(raw or x.keyed_requests(), x.by_request)


@query
def online_payments_valid(x: Inputs) -> DataFrame:
    return online.valid_payments(
        x.request_table("staging_user_payments"), online.valid_orders(x.request_table("staging_user_orders"))
    )


@query
def online_payments_rejected(x: Inputs) -> DataFrame:
    raw = x.request_table("staging_user_payments")
    valid = online.valid_payments(raw, online.valid_orders(x.request_table("staging_user_orders")))
    return online.rejected_payments(raw, valid)


@query
def online_items_valid(x: Inputs) -> DataFrame:
    return online.valid_items(
        x.request_table("staging_user_order_items"), online.valid_orders(x.request_table("staging_user_orders"))
    )


@query
def online_items_rejected(x: Inputs) -> DataFrame:
    raw = x.request_table("staging_user_order_items")
    valid = online.valid_items(raw, online.valid_orders(x.request_table("staging_user_orders")))
    return online.rejected_items(raw, valid)


@query
def rejected_gate(x: Inputs) -> DataFrame:
    raw = x.keyed_requests()
    return online.rejected_gate(_checked(x, raw), raw["staging_user_orders"])


@query
def rejected_reasons(x: Inputs) -> DataFrame:
    return online.rejected_reasons(_checked(x))


@query
def online_order_conflicts(x: Inputs) -> DataFrame:
    return online.order_conflicts(online.valid_orders(x.request_table("shared_orders")))


def _features(x: Inputs, checked: dict[str, DataFrame], parts: dict[str, DataFrame]) -> DataFrame:
    passed = online.pass_gate(checked, x.by_request)
    merged = online.history_of_requests(passed, parts["history"])
    return materialize(online.request_features(passed, parts["encodings"], merged), "request_features")


def _served(x: Inputs, raw: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """What serving takes from the typed tables, and the feature rows of all passed requests."""
    parts = x.serving_parts
    return parts, _features(x, _checked(x, raw), parts)


@query
def online_constraint_violations(x: Inputs) -> DataFrame:
    raw = x.keyed_requests()
    named = {f"user_{n.removeprefix('staging_user_')}": df for n, df in raw.items()}
    return checks.constraint_violations(named | {"user_features": _served(x, raw)[1]}, checks.ONLINE_CONSTRAINTS)


@query
def history_upsert(x: Inputs) -> DataFrame:
    base = history.seller_history_base(x.items(), x.orders())
    passed = online.pass_gate(_checked(x), held_requests=x.by_request)
    return history.upsert_history(base, history.online_history(passed["orders"], passed["items"])).drop("created_at")


@query
def online_features(x: Inputs) -> DataFrame:
    return rounded(online.complete_features(_served(x)[1]), "price_std")


@query
def online_features_refused(x: Inputs) -> DataFrame:
    return online.refused_features(_served(x)[1])


@query
def train_serve_parity(x: Inputs) -> DataFrame:
    served = _served(x)[1]
    return online.train_serve_parity(rounded(_view(x), "price_std"), rounded(served, "price_std"))


# ---- sorts, upserts, retention ------------------------------------------------------------


@query
def sort_null_order(x: Inputs) -> DataFrame:
    return x.orders().orderBy(F.col("delivered_customer_date").desc_nulls_first(), F.col("order_id").asc_nulls_last())


@query
def upsert_by_key(x: Inputs) -> DataFrame:
    raw = x.request_table("staging_user_orders")
    first, retry = (online.valid_orders(raw.filter(F.col("customer_city") == c)) for c in ("first", "retry"))
    return upsert.upsert_by_key(first, retry, ["request_id"])


@query
def retention_filter(x: Inputs) -> DataFrame:
    return upsert.keep_recent(x.request_table("staging_user_order_items"), AS_OF, 14)


def _first_and_retry(x: Inputs) -> tuple[StoredTable, DataFrame]:
    """A stored table of the first order rows, and the rows of the second submissions."""
    raw = x.request_table("staging_user_orders")
    first, retry = (online.valid_orders(raw.filter(F.col("customer_city") == c)) for c in ("first", "retry"))
    table = StoredTable(x.spark, new_folder(x.spark, "user-orders"), first.schema, ["request_id"], "ingested_at", age_unit=None)
    table.append(first)
    return table, retry


@query
def stored_upsert(x: Inputs) -> DataFrame:
    table, retry = _first_and_retry(x)
    table.upsert(retry)
    return table.read()


@query
def upsert_keys(x: Inputs) -> DataFrame:
    table, retry = _first_and_retry(x)
    return table.upsert(retry)


def _online_tables(x: Inputs) -> tuple[RequestStore, dict[str, T.StructType]]:
    """The seven online tables and the refused rows, stored as by one batch of all requests."""
    raw = x.keyed_requests()
    checked = _checked(x, raw)
    served = _features(x, checked, x.serving_parts)
    frames = {n: df.drop(online.TYPED_ID) for n, df in raw.items()} | {f"valid_{n}": checked[n] for n in VALID_KEYS}
    frames |= {"features": served, "refused_features": online.refused_features(served)}
    store = RequestStore(x.spark, new_folder(x.spark, "requests"), buckets=4, age_unit="year")
    store.write_all(frames, 0, dealt=True)
    return store, {name: df.schema for name, df in frames.items()}


def _row_counts(x: Inputs, change: Callable[[RequestStore, dict[str, T.StructType]], None]) -> DataFrame:
    """Rows of each stored table before and after a change."""
    store, schemas = _online_tables(x)

    def counts(column: str) -> DataFrame:
        parts = [store.read(n, s).agg(F.count("*").alias(column)).withColumn("table_name", F.lit(n)) for n, s in schemas.items()]
        return materialize(reduce(DataFrame.unionByName, parts), column)

    before = counts("rows_before")
    change(store, schemas)
    return before.join(counts("rows_after"), "table_name")


@query
def retention_tables(x: Inputs) -> DataFrame:
    return _row_counts(x, lambda store, schemas: store.expire(schemas, AS_OF, 14))


@query
def reset_tables(x: Inputs) -> DataFrame:
    return _row_counts(x, lambda store, schemas: store.reset(schemas))


# ---- survival -----------------------------------------------------------------------------


def _open_rows(x: Inputs) -> DataFrame:
    """Fixture rows with the days to the second order, NULL if there is none."""
    second = x.spark.sql(
        "SELECT id, second_date FROM (SELECT CAST(o_custkey AS STRING) AS id, CAST(o_orderdate AS DATE) AS second_date, "
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n "
        "FROM orders) WHERE n = 2"
    )
    rows = x.fixture("survival_rows").join(second, "id", "left")
    return rows.select(
        "id", "t_pred_date", "n_orders", survival.EVENT, "risk_score",
        F.datediff("second_date", "t_pred_date").alias(survival.DAYS),
    )


def _survival(x: Inputs) -> DataFrame:
    last = x.spark.sql("SELECT CAST(max(o_orderdate) AS DATE) FROM orders").first()[0]
    return survival.censor_durations(_open_rows(x), last)


@query
def censor_durations(x: Inputs) -> DataFrame:
    return _survival(x).drop("n_orders")


@query
def survival_target(x: Inputs) -> DataFrame:
    target = survival.survival_target()
    return _survival(x).select("id", target["event"].alias("event"), target["duration"].cast("double").alias("duration"))


@query
def split_temporal_stratified(x: Inputs) -> DataFrame:
    return survival.split_temporal_stratified(_survival(x), "id").select("id", survival.EVENT, "split")


@query
def stratified_folds(x: Inputs) -> DataFrame:
    return survival.stratified_folds(_survival(x), "id").select("id", survival.EVENT, "fold")


@query
def permute_column(x: Inputs) -> DataFrame:
    return survival.permute_column(_survival(x), "id", "risk_score", 13, 0).select("id", "risk_score")


@query
def person_period(x: Inputs) -> DataFrame:
    return survival.person_period(_survival(x), 30).select("id", "period", "period_event")


@query
def survival_summaries(x: Inputs) -> DataFrame:
    points = x.fixture("survival_curve_points")
    # Seven points per curve.
    curves = points.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "t", "s"))).alias("p"))
    curves = curves.select("id", F.col("p.t").alias("times"), F.col("p.s").alias("survival"))
    return survival.survival_summaries(curves).drop("times", "survival")


@query
def kaplan_meier(x: Inputs) -> DataFrame:
    return rounded(survival.kaplan_meier(_survival(x)), "survival", "cumulative_hazard")


@query
def c_index(x: Inputs) -> DataFrame:
    return conc.concordance(_survival(x), survival.DAYS, survival.EVENT, "risk_score")


def _scored_features(x: Inputs) -> DataFrame:
    """C-index above one half of each numeric column taken as the risk."""
    names = ("risk_score", "n_orders")
    long = _survival(x).select(
        survival.EVENT, survival.DAYS,
        F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("risk")) for c in names))).alias("c"),
    ).select(survival.EVENT, survival.DAYS, "c.*")
    scores = conc.concordance(long, survival.DAYS, survival.EVENT, "risk", ["feature"])
    return scores.select("feature", (F.col("c_index") - 0.5).alias("importance"))


@query
def select_features(x: Inputs) -> DataFrame:
    return rounded(models.select_features(_scored_features(x)), "importance")


# ---- models: facts that every fitted model has -------------------------------------------------------------------

def _splits(x: Inputs) -> tuple[DataFrame, list[str]]:
    """The split rows and all trainable columns."""
    view = _view(x)
    names = features.trainable(view).columns
    rows = survival.censor_durations(view).filter(F.col(survival.DAYS) >= 0)
    rows = models.align_to_model(rows, names, ["order_id", "t_pred_date", survival.EVENT, survival.DAYS])
    return materialize(survival.split_temporal_stratified(rows, "order_id"), "splits"), names


def _inside(value: Column, low: float, high: float) -> Column:
    return value.between(low, high).cast("int")


def _fast_model(x: Inputs) -> models.HazardForestModel:
    """A forest of the published settings, fitted on the train split, stored, and read back."""
    splits, _ = _splits(x)
    forest = models.tuned_forest(models.TUNED)
    trained = models.Trained(forest.fit(splits.filter("split = 'train'")), float("nan"), forest.value("features"))
    folder = new_folder(x.spark, "model")
    models.save(x.spark, trained, folder)
    return models.load(x.spark, folder)


@query
def score_risk(x: Inputs) -> DataFrame:
    splits, names = _splits(x)
    model = models.HazardForest(features=names).fit(splits.filter("split = 'train'"))
    scored = model.risk(splits.filter("split = 'test'"), ["order_id"])
    # A cumulative hazard of at most one per period, summed over the time grid.
    periods = model.value("periods")
    return scored.select("order_id", _inside(F.col("risk_score"), 0, periods * (periods + 1) / 2).alias("risk_in_bounds"))


@query
def permutation_importance(x: Inputs) -> DataFrame:
    splits, names = _splits(x)
    model = models.HazardForest(features=names).fit(splits.filter("split = 'train'"))
    held = splits.filter("split = 'validation'")
    base = models.c_index(model.risk(held, ["order_id", survival.EVENT, survival.DAYS]))
    found = models.permutation_importance(model, held, "order_id", base)
    return found.select("feature", _inside(F.col("importance"), base - 1, base).alias("importance_in_bounds"))


@query
def grid_search(x: Inputs) -> DataFrame:
    splits, names = _splits(x)
    forest = models.HazardForest(features=names)
    grid = models.param_grid(forest)
    found = models.grid_search(splits.filter("split = 'train'"), "order_id", forest, grid)
    scores = models.grid_scores(x.spark, found, grid)
    return scores.withColumn("c_index_in_bounds", _inside(F.col("c_index"), 0, 1)).drop("c_index")


@query
def model_metadata(x: Inputs) -> DataFrame:
    splits, names = _splits(x)
    trained = models.train(splits, "order_id", names, metadata=models.TUNED)
    params = F.col("final_model_params")
    row = models.model_metadata(x.spark, trained).select(
        "model_type", "num_selected_features", params["numTrees"].alias("num_trees"), params["maxDepth"].alias("max_depth"),
        params["minInstancesPerNode"].alias("min_instances_per_node"), _inside(F.col("test_c_index"), 0, 1).alias("c_index_in_bounds"),
    )
    return row.withColumn("test_rows", F.lit(splits.filter("split = 'test'").count()).cast("long"))


@query
def train_modes(x: Inputs) -> DataFrame:
    """Base training and fast retrain; each model is stored, read back and scores as before."""
    splits, names = _splits(x)
    test = splits.filter("split = 'test'")
    rows = []
    for mode, options in (("base", {"permute": False, "tune": False}), ("fast", {"metadata": models.TUNED})):
        trained = models.train(splits, "order_id", names, **options)
        folder = new_folder(x.spark, f"model-{mode}")
        models.save(x.spark, trained, folder)
        before, after = (m.risk(test, ["order_id"]) for m in (trained.model, models.load(x.spark, folder)))
        rows.append((mode, len(trained.features), int(0 <= trained.test_c_index <= 1), int(before.exceptAll(after).isEmpty())))
    return x.spark.createDataFrame(rows, "mode string, features_kept int, c_index_in_bounds int, reloaded_scores_equal int")


def _checked_scores(scored: DataFrame, model: models.HazardForestModel, series: DataFrame) -> DataFrame:
    """Each prediction record against the curve it comes from, summed over the curve's points."""
    width, periods = model.value("width"), model.value("periods")
    curve = series.select("request_id", F.posexplode("survival").alias("i", "s"))
    # The trapezoids between the points, each point with its share of them.
    share = F.when(F.col("i").isin(0, periods - 1), 0.5).otherwise(1.0)
    again = curve.groupBy("request_id").agg(
        F.min(F.when(F.col("s") <= 0.5, (F.col("i") + 1) * width)).alias("median"),
        F.sum(F.col("s") * share * width).alias("mean"),
    )
    median = F.col("median_days_until_second_purchase").eqNullSafe(F.col("median").cast("double"))
    return scored.join(again, "request_id").select(
        "request_id",
        _inside(F.col("risk_score"), 0, 1e9).alias("risk_in_bounds"),
        median.cast("int").alias("median_recomputed"),
        (F.abs(F.col("restricted_mean_survival_days") - F.col("mean")) < 1e-6 * periods * width).cast("int").alias("mean_recomputed"),
        (F.col("note") == models.NOTE).cast("int").alias("has_note"),
    )


@query
def score_requests(x: Inputs) -> DataFrame:
    model = _fast_model(x)
    series = materialize(model.curves(online.complete_features(_served(x)[1]), ["request_id"]), "curves")
    return _checked_scores(models.score_curves(series), model, series)


# ---- streaming ----------------------------------------------------------------------------


def _stream(x: Inputs, flow: RequestFlow, batches: int = 3) -> None:
    """Run all requests through the stream in several micro-batches.

    Rows arrive in order of time, as a stream delivers them, so most rows of a request come together
    and a batch looks again at few earlier requests. The payload files are compressed, and there are
    as many as the rows need; a file source goes by file times.
    """
    source, raw = new_folder(x.spark, "payloads"), x.requests()
    packed = request_source.pack_requests(*raw.values())
    files = max(1, pieces_of(packed.count()) // batches)
    shares = [i / batches for i in range(1, batches)]
    ends = raw["staging_user_orders"].agg(F.percentile_approx("ingested_at", shares)).first()[0] or []
    turn = reduce(Column.__add__, (F.when(F.col("ingested_at") > end, 1).otherwise(0) for end in ends), F.lit(0))
    for batch in range(batches):
        arrived = packed.filter(turn == batch).coalesce(files)
        arrived.write.mode("append").option("compression", "gzip").json(source)
    written = len(request_source.read_requests(x.spark, source).inputFiles())
    payloads = request_source.stream_requests(x.spark, source, files_per_batch=max(1, -(-written // batches)))
    run = flow.start(payloads, new_folder(x.spark, "stream-checkpoint"))
    run.awaitTermination()


def _store(x: Inputs) -> RequestStore:
    # The requests cover years; folders by day suit a store of two weeks.
    return RequestStore(x.spark, new_folder(x.spark, "requests"), buckets=4, age_unit=None)


class _IngestOnly(RequestFlow):
    def process(self, payloads: DataFrame, batch_id: int) -> None:
        self.ingest(payloads, batch_id)


@query
def stream_ingest(x: Inputs) -> DataFrame:
    store = _store(x)
    _stream(x, _IngestOnly(store))
    parts = []
    for name in schemas.REQUEST_COLUMNS:
        staged = store.read(name, store.schemas[name]).filter("request_id IS NOT NULL")
        parts.append(staged.groupBy("request_id").agg(F.count("*").alias("staged_rows")).withColumn("table_name", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _validated(x: Inputs) -> tuple[RequestStore, dict[str, DataFrame]]:
    store = _store(x)
    _stream(x, RequestFlow(store))
    tables_now = {n: store.current(f"valid_{n}", store.schemas[f"valid_{n}"], keys) for n, keys in VALID_KEYS.items()}
    tables_now |= {n: store.of_last_batch(n, store.schemas[n]) for n in online.REJECTED_TABLES}
    return store, tables_now


@query
def stream_validate(x: Inputs) -> DataFrame:
    _, now = _validated(x)
    parts = [
        df.filter("request_id IS NOT NULL").groupBy("request_id").agg(F.count("*").alias("table_rows")).withColumn("table_name", F.lit(n))
        for n, df in now.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def stream_latest_wins(x: Inputs) -> DataFrame:
    return _validated(x)[1]["orders"]


@query
def stream_retries(x: Inputs) -> DataFrame:
    """Every order row arrives, and again a day and three days later; the stream keeps the first.

    Years come one after the other, as a stream delivers them: the files of a year are written by several
    tasks, and a run of the stream takes all that came since the last one as one batch.
    """
    arrivals = F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("_later")
    orders = x.request_table("staging_user_orders").filter("request_id IS NOT NULL")
    again = orders.select("*", arrivals).withColumn("ingested_at", F.col("ingested_at") + F.make_dt_interval("_later")).drop("_later")
    source, sink, checkpoint = (new_folder(x.spark, n) for n in ("arrivals", "first-arrivals", "stream-checkpoint"))
    year = F.year("ingested_at")
    for (arrived,) in again.select(year).distinct().orderBy(1).collect():
        again.filter(year.eqNullSafe(F.lit(arrived))).write.mode("append").parquet(source)
        stream = x.spark.readStream.schema(again.schema).parquet(source)
        run = (
            without_retries(stream, "14 days").writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    kept = x.spark.read.schema(again.schema).parquet(sink)
    return kept.groupBy("request_id").agg(F.count("*").alias("payloads"), F.min("ingested_at").cast("date").alias("first_arrival"))


@query
def stream_score(x: Inputs) -> DataFrame:
    model = _fast_model(x)
    parts = x.feature_parts
    store = _store(x)
    _stream(x, RequestFlow(store, parts["encodings"], parts["history"], lambda rows: models.score_requests(model, rows)))
    rows = online.complete_features(store.of_last_batch("features", store.schemas["features"]))
    return _checked_scores(store.of_last_batch("scores", store.schemas["scores"]), model, model.curves(rows, ["request_id"]))
