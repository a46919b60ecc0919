from __future__ import annotations

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from ledgerloom.operators import ordered, parents, upsert
from ledgerloom.operators.concordance import concordance
from ledgerloom.operators.dedupe import dedupe_latest, dedupe_total_order
from ledgerloom.operators.parents import mark_missing
from ledgerloom.operators.rules import refused


def skewed(spark, n=3000):
    """A third of the rows share one group."""
    rng = random.Random(7)
    data = [("hot" if i % 3 == 0 else f"g{rng.randrange(40)}", f"{rng.random():.12f}", rng.randrange(100)) for i in range(n)]
    return spark.createDataFrame(data, "g string, k string, v int")


@pytest.mark.parametrize("group", [["g"], []])
def test_ordered_prefix_split_equals_window(spark, group):
    df = skewed(spark)
    got = ordered.ordered_prefix(df, group, "k", {"before": F.col("v")}, pieces=16)
    assert "_piece" not in got.columns
    w = Window.partitionBy(*group).orderBy("k")
    want = df.withColumn("before", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "position", F.row_number().over(w) - 1
    )
    assert rows(got.select("g", "k", "position", "before"), "k") == rows(want.select("g", "k", "position", "before"), "k")


def test_ordered_prefix_pieces_grow_with_the_rows(spark):
    assert ordered.pieces_of(1000, rows_per_piece=10) == 100
    assert ordered.pieces_of(1000) == ordered.pieces_of(0) == 1


def test_ordered_prefix_one_group_is_cut_into_pieces(spark):
    # All rows in one group: no piece holds more than a small multiple of its share.
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    placed = df.repartitionByRange(16, "g", "k").groupBy(F.spark_partition_id()).count()
    assert placed.agg(F.max("count")).first()[0] < 4000 / 16 * 2
    got = ordered.ordered_prefix(df, ["g"], "k", pieces=16)
    assert [r["position"] for r in got.orderBy("k").collect()] == list(range(4000))


def test_ordered_prefix_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 1.0, 1), ("a", 0.5, 9), ("a", 1.0, 2)], "g string, k double, t int")
    got = ordered.ordered_prefix(df, ["g"], "k", pieces=4, ties=["t"])
    assert [r["t"] for r in got.orderBy("position").collect()] == [9, 1, 2, 3]


def test_ordered_prefix_number_keys_and_hot_key(spark):
    # One key value shared by a third of the rows, each in a group of its own.
    data = [(f"a{i}", 5.0) for i in range(400)] + [("z", float(i) / 7) for i in range(800)]
    df = spark.createDataFrame(data, "g string, k double")
    got = ordered.ordered_prefix(df, ["g"], "k", pieces=8)
    assert got.count() == 1200
    z = [r["position"] for r in got.filter("g = 'z'").orderBy("k").collect()]
    assert z == list(range(800))


def test_repeated_parent_keys_multiply_nothing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    parent = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(mark_missing(df, "k", parent, "missing"), "k") == [(None, None), ("a", False), ("b", True)]


def test_dedupe_total_order_is_independent_of_partitioning(spark):
    data = [("a", "2", None), ("a", "1", "x"), ("a", "1", None), (None, "9", "q"), (None, "8", "q")]
    df = spark.createDataFrame(data, "k string, x string, y string")
    want = [(None, "8", "q"), ("a", "1", "x")]
    for n in (1, 3, 7):
        assert rows(dedupe_total_order(df.repartition(n), ["k"]), "k") == want


def test_dedupe_plan_limits_groups_before_the_shuffle(spark):
    plan = dedupe_total_order(skewed(spark), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dedupe_latest(spark):
    data = [("a", "old", datetime(2020, 1, 1)), ("a", "new", datetime(2020, 1, 2)), ("a", "none", None), ("b", "y", None), ("b", "x", None)]
    df = spark.createDataFrame(data, "k string, x string, ingested_at timestamp")
    assert rows(dedupe_latest(df, ["k"]).select("k", "x"), "k") == [("a", "new"), ("b", "x")]


def test_parents(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    parent = spark.createDataFrame([("a",), ("c",)], "id string")
    assert rows(parents.keep_with_parent(df, "k", parent, "id")) == [("a", 1)]
    marked = parents.mark_missing(df, "k", parent, "gone", "id")
    assert rows(marked.select("v", "gone"), "v") == [(1, False), (2, True), (3, None)]


def test_first_reason_wins(spark):
    df = spark.createDataFrame([(None, None), ("a", None), ("a", "b")], "x string, y string")
    rules = [(F.col("x").isNull(), "no x"), (F.col("y").isNull(), "no y"), (F.col("y") == "b", None)]
    assert rows(refused(df, rules).select("rejected_reason")) == [("no x",), ("no y",), (None,)]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep")], "k int, v string, c string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(upsert.upsert_by_key(target, new, ["k"], ["v"]), "k") == [(1, "a", "keep"), (2, "B", "keep"), (3, "C", None)]
    assert rows(upsert.upsert_by_key(target, new, ["k"]), "k") == [(1, "a", "keep"), (2, "B", None), (3, "C", None)]
    again = upsert.upsert_by_key(upsert.upsert_by_key(target, new, ["k"], ["v"]), new, ["k"], ["v"])
    assert again.count() == 3


def test_replacing_a_request_removes_its_stale_rows(spark):
    target = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 1)], "request_id string, item int")
    again = spark.createDataFrame([("r1", 1), ("r1", 7)], "request_id string, item int")
    assert rows(upsert.upsert_by_key(target, again, ["request_id"]), "request_id", "item") == [("r1", 1), ("r1", 7), ("r2", 1)]


def test_retention_keeps_unknown_age(spark):
    df = spark.createDataFrame([(1, datetime(2020, 1, 1)), (2, datetime(2020, 1, 20)), (3, None)], "k int, ingested_at timestamp")
    kept = upsert.keep_recent(df, datetime(2020, 1, 31), 14)
    assert rows(kept.select("k"), "k") == [(2,), (3,)]
    assert upsert.emptied(df).count() == 0 and upsert.emptied(df).schema == df.schema


def brute_force(data):
    good = bad = tied = 0
    for (t, e, r), (u, f, s) in itertools.permutations(data, 2):
        if e and (u > t or (u == t and not f)):
            good, bad, tied = good + (r > s), bad + (r < s), tied + (r == s)
    return good, bad, tied


@pytest.mark.parametrize("risks", [3, 40, 10_000])
def test_concordance_equals_brute_force(spark, risks):
    rng = random.Random(risks)
    data = [(rng.randrange(30), rng.random() < 0.4, float(rng.randrange(risks)) / 3) for _ in range(300)]
    # A third of the rows share one risk and one duration.
    data += [(7, i % 2 == 0, 1.0) for i in range(150)]
    df = spark.createDataFrame(data, "t int, e boolean, r double")
    row = concordance(df, "t", "e", "r").first()
    assert tuple(int(row[c]) for c in ("concordant", "discordant", "tied_risk")) == brute_force(data)
    mirrored = concordance(df.withColumn("r", -F.col("r")), "t", "e", "r").first()
    assert row["c_index"] + mirrored["c_index"] == pytest.approx(1.0)


def test_concordance_small_cases(spark):
    # Equal times: an event is comparable to a censored row, two events are not.
    df = spark.createDataFrame([(5, True, 1.0), (5, False, 1.0), (5, True, 9.0)], "t int, e boolean, r double")
    row = concordance(df, "t", "e", "r").first()
    assert tuple(int(row[c]) for c in ("concordant", "discordant", "tied_risk")) == (1, 0, 1)
    assert row["c_index"] == 0.75


def test_concordance_by_group(spark):
    data = [("a", 1, True, 2.0), ("a", 2, False, 1.0), ("b", 1, True, 1.0), ("b", 2, False, 2.0)]
    df = spark.createDataFrame(data, "g string, t int, e boolean, r double")
    got = concordance(df, "t", "e", "r", ["g"])
    assert rows(got.select("g", "c_index"), "g") == [("a", 1.0), ("b", 0.0)]


def test_concordance_of_fractional_durations_in_pieces(spark):
    """Every duration differs, so the block of all rows has as many durations as rows."""
    import random

    from ledgerloom.operators.concordance import concordance

    rng = random.Random(2)
    data = [(rng.random() * 10, int(rng.random() < 0.6), rng.choice([0.5, 1.0, 2.0, rng.random()])) for _ in range(300)]
    good = bad = ties = 0
    for a in data:
        for b in data:
            if a[1] and (b[0] > a[0] or (b[0] == a[0] and not b[1] and a is not b)):
                good, bad, ties = good + (a[2] > b[2]), bad + (a[2] < b[2]), ties + (a[2] == b[2])
    df = spark.createDataFrame([*data, (None, 1, 3.0)], "days double, event int, risk double")
    for pieces in (1, 7):
        got = concordance(df, "days", "event", "risk", pieces=pieces).first()
        assert (got["concordant"], got["discordant"], got["tied_risk"]) == (good, bad, ties)


def test_kaplan_meier_in_pieces(spark):
    import math
    import random

    from ledgerloom.plans.survival import kaplan_meier

    rng = random.Random(6)
    data = [(rng.choice([rng.random() * 9, 3.0, 5.5]), int(rng.random() < 0.5)) for _ in range(200)] + [(20.0, 1)]
    want, s, h = [], 1.0, 0.0
    for t in sorted({t for t, _ in data}):
        at_risk, events = sum(u >= t for u, _ in data), sum(e for u, e in data if u == t)
        s, h = s * (1 - events / at_risk), h + events / at_risk
        want.append((t, at_risk, events, s, h))
    df = spark.createDataFrame([*data, (None, 1)], "t double, e int")
    for pieces in (1, 5):
        got = kaplan_meier(df, "t", "e", pieces=pieces).orderBy("duration").collect()
        assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
        assert all(math.isclose(r[3], w[3], abs_tol=1e-9) and math.isclose(r[4], w[4], abs_tol=1e-9) for r, w in zip(got, want, strict=True))
