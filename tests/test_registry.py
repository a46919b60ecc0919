from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, rows_of
from conftest import SF

# One query per family; check_oracles.py compares all of them.
CHECKED = [
    "scan_csv_staging", "option_lists", "cast_price_nonzero", "clean_item_orders", "clean_payments", "rejected_item_orders",
    "audit_totals", "constraint_violations", "seller_history_to_date", "payment_rollup", "review_rollup", "order_targets",
    "item_order_features", "customer_features_wide", "online_items_rejected", "rejected_gate", "online_features",
    "split_temporal_stratified", "stratified_folds", "c_index", "kaplan_meier", "survival_summaries",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, db, name):
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, result.fetchall())
    assert isinstance(got, Counter) and got == want


def test_no_plan_pairs_all_rows(spark):
    for name in ("customer_features_wide", "online_features", "c_index", "permute_column", "rejected_item_orders"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
