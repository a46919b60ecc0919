"""Inputs of the registered queries: the given tables and the fixture tables derived from them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import clean, features, online
from ledgerloom.session import BROADCAST_ROWS, Keep, buckets_of, configure, materialize, materialize_all, materialize_by
from ledgerloom.sources import schemas
from registry.fixtures import dealt_sql, spark_sql

SOURCES = ("customer", "supplier", "part", "orders", "lineitem")


class Inputs:
    """Lazily derived inputs of one query run."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        for name in SOURCES:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)

    def fixture(self, name: str) -> DataFrame:
        sql = spark_sql(name)
        if name == "shared_orders":
            sql = sql.replace("FROM staging_user_orders", f"FROM ({spark_sql('staging_user_orders')})")
        return self.spark.sql(sql)

    def raw(self) -> dict[str, DataFrame]:
        return {name: self.fixture(name) for name in schemas.STAGING_COLUMNS}

    def request_table(self, name: str) -> DataFrame:
        """Request tables are stored tables, not views: validation filters on many cast columns,
        and the optimizer would repeat a view's expressions in each of them."""
        return materialize(self.fixture(name), name)

    def requests(self) -> dict[str, DataFrame]:
        return materialize_all({name: self.fixture(name) for name in schemas.REQUEST_COLUMNS})

    def keyed_requests(self) -> dict[str, DataFrame]:
        """The same rows in buckets of typed request ids, as validation, gate and features go by request."""
        few = self.spark.table("supplier").count() <= BROADCAST_ROWS
        below = {n: self.spark.sql(dealt_sql(n, self.buckets, few)) for n in schemas.REQUEST_COLUMNS if n != "staging_user_orders"}
        frames = {n: online.split_id(below[n] if n in below else self.fixture(n)) for n in schemas.REQUEST_COLUMNS}
        stored = materialize_by(online.TYPED_ID, self.buckets)(frames)
        return {name: online.whole_id(df) for name, df in stored.items()}

    @cached_property
    def buckets(self) -> int:
        return buckets_of(self.spark.table("lineitem").count())

    @property
    def by_order(self) -> Keep:
        return materialize_by("order_id", self.buckets)

    @property
    def by_request(self) -> Keep:
        """Refused rows stay part of their reader's plan: each query reads them once, and few of their columns."""
        bucketed = materialize_by("request_id", self.buckets)

        def keep(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
            stored = {name: df for name, df in frames.items() if name not in online.REJECTED_TABLES}
            return {**frames, **(bucketed(stored) if stored else {})}

        return keep

    # Typed tables, straight from the raw tables.

    def orders(self) -> DataFrame:
        return clean.clean_orders(self.fixture("staging_orders"))

    def categories(self) -> DataFrame:
        return clean.clean_product_category(self.fixture("staging_product_category"))

    def products(self) -> DataFrame:
        return clean.clean_products(self.fixture("staging_products"), self.categories())

    def sellers(self) -> DataFrame:
        return clean.clean_sellers(self.fixture("staging_sellers"))

    def items(self) -> DataFrame:
        return clean.clean_item_orders(
            self.fixture("staging_item_orders"), self.orders(), self.sellers(), self.products()
        )

    def customers(self) -> DataFrame:
        return clean.clean_customers(self.fixture("staging_customers"), self.orders())

    def payments(self, with_sequence: bool = False) -> DataFrame:
        return clean.clean_payments(self.fixture("staging_payments"), self.orders(), with_sequence)

    def reviews(self) -> DataFrame:
        return clean.clean_reviews(self.fixture("staging_reviews"), self.orders())

    def keyed_raw(self, store: bool = True) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """The raw tables, those with an order id dealt into buckets of it, and the typed tables made for that.
        Items hold the category of their product. They are stored once unless each is read once."""
        raw = self.raw()
        known = materialize_all({"product_category": self.categories(), "products": self.products()})
        items = clean.with_product_category(raw["staging_item_orders"], known["products"])
        below = {n: raw[n] for n in ("staging_orders", "staging_payments", "staging_reviews")} | {"staging_item_orders": items}
        split = {n: clean.split_order(df) for n, df in below.items()}
        if store:
            split = materialize_by(clean.TYPED_ORDER, self.buckets)(split)
        else:
            split = {n: df.repartition(self.buckets, clean.TYPED_ORDER) for n, df in split.items()}
        return raw | {n: clean.whole_order(df, below[n].columns) for n, df in split.items()}, known

    def stored(self, with_reviews: bool = True) -> dict[str, DataFrame]:
        """All typed tables, each written once to shared storage, in buckets of orders."""
        raw, known = self.keyed_raw(store=False)
        return clean.clean_all(raw, self.by_order, with_sequence=False, with_reviews=with_reviews, with_category=True, known=known)

    @cached_property
    def typed(self) -> dict[str, DataFrame]:
        return self.stored(with_reviews=False)

    @cached_property
    def serving_parts(self) -> dict[str, DataFrame]:
        """Inputs of the features of requests."""
        return features.serving_inputs(self.typed, self.by_order)

    @cached_property
    def feature_parts(self) -> dict[str, DataFrame]:
        """Inputs of the purchase-time view, derived once for a query that also serves requests."""
        return features.feature_inputs(self.typed, self.by_order, self.serving_parts)
