"""Censoring, targets, splits, folds, person-period rows, curve summaries and baselines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import curves
from ledgerloom.operators.ordered import ordered_prefix
from ledgerloom.session import materialize

# Fixed value: last day of the study.
STUDY_END = date(2018, 9, 3)

EVENT = "has_second_purchase"
DAYS = "days_until_second_purchase"


def censor_durations(df: DataFrame, study_end: date | Column = STUDY_END) -> DataFrame:
    """Rows without a next purchase last until the study end (negative if they start after it)."""
    end = study_end if isinstance(study_end, Column) else F.lit(study_end)
    return df.withColumn(DAYS, F.coalesce(F.col(DAYS), F.datediff(end, "t_pred_date")))


def survival_target() -> Column:
    return F.struct(F.col(EVENT).cast("boolean").alias("event"), F.col(DAYS).cast("float").alias("duration"))


def split_temporal_stratified(df: DataFrame, key: str) -> DataFrame:
    """Add ``split``: inside each event class the earliest 7/8 of the first 80% train, the rest
    of the 80% validate, and the latest 20% test.

    There are only two classes, so positions come from range buckets, not from one window per
    class. ``key`` breaks ties of the same day.
    """
    df = materialize(df, "split")
    keyed = df.withColumn("_key", F.concat(F.col("t_pred_date").cast("string"), F.col(key).cast("string")))
    placed = ordered_prefix(keyed, [EVENT], "_key", position="_at", store=False)
    sizes = df.groupBy(EVENT).agg(F.count("*").alias("_n"))
    kept = F.floor(F.col("_n") * F.lit(0.8))
    train = F.floor(kept * F.lit(7 / 8))
    split = F.when(F.col("_at") < train, "train").when(F.col("_at") < kept, "validation").otherwise("test")
    return placed.join(sizes, EVENT).withColumn("split", split).select(*df.columns, "split")


def stratified_folds(df: DataFrame, key: str, k: int = 5, seed: int = 13) -> DataFrame:
    """Add ``fold``: rows of each event class in hashed order, dealt round robin."""
    keyed = df.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    dealt = ordered_prefix(keyed, [EVENT], "_key", position="_at")
    return dealt.withColumn("fold", (F.col("_at") % k).cast("int")).select(*df.columns, "fold")


def permute_column(df: DataFrame, key: str, column: str, seed: int, repetition: int) -> DataFrame:
    """Replace ``column`` by a seeded permutation of its values: the i-th row by key gets the
    value of the i-th row in hashed order."""
    df = materialize(df, "permute")
    salt = F.concat(F.lit(f"{seed}:{repetition}:"), F.col(key).cast("string"))
    places = df.withColumn("_key", F.col(key).cast("string"))
    places = ordered_prefix(places, [], "_key", position="_at", store=False).drop("_key")
    drawn = df.select(F.md5(salt).alias("_key"), F.col(column).alias("_value"))
    drawn = ordered_prefix(drawn, [], "_key", position="_at", store=False)
    swapped = places.join(drawn.select("_at", "_value"), "_at")
    return swapped.withColumn(column, F.col("_value")).select(*df.columns)


def person_period(df: DataFrame, width: int = 30, horizon: int | None = None) -> DataFrame:
    """One row per person and period at risk; ``period_event`` is 1 in the period of the event.

    Day 0 belongs to the first period. Negative durations have no period at risk and are left
    out; ``negative_durations`` lists them. ``horizon`` (days) ends the follow-up.
    """
    limit = F.col(DAYS) if horizon is None else F.least(F.col(DAYS), F.lit(horizon))
    last = F.greatest(F.floor((limit - 1) / width), F.lit(0).cast("long"))
    happened = (F.col(EVENT) == 1) if horizon is None else (F.col(EVENT) == 1) & (F.col(DAYS) <= horizon)
    at_risk = df.filter(F.col(DAYS) >= 0).withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return at_risk.withColumn("period_event", F.when(happened & (F.col("period") == last), 1).otherwise(0))


def negative_durations(df: DataFrame) -> DataFrame:
    """Rows that end before they start, with a reason; they cannot be trained on."""
    return df.filter(F.col(DAYS) < 0).withColumn("reason", F.lit("duration is negative"))


def survival_summaries(df: DataFrame, times: str = "times", survival: str = "survival") -> DataFrame:
    """Median and restricted mean of each curve."""
    t, s = F.col(times), F.col(survival)
    return df.withColumns(
        {
            "median_days_until_second_purchase": curves.median_time(t, s),
            "restricted_mean_survival_days": curves.restricted_mean(t, s),
        }
    )


def kaplan_meier(
    df: DataFrame, duration: str = DAYS, event: str = EVENT, pieces: int | None = None
) -> DataFrame:
    """Survival (Kaplan-Meier) and cumulative hazard (Nelson-Aalen) at each distinct duration.

    Running sums go over range pieces of durations, so durations may be of any kind and number.
    The product of (1 - hazard) is summed as logarithms; it is 0 from the first hazard of 1 on.
    Rows without a duration are left out.
    """
    known = df.filter(F.col(duration).isNotNull())
    everyone = known.count()
    by_time = known.groupBy(F.col(duration).alias("duration")).agg(
        F.count("*").alias("leaving"), F.sum(F.col(event).cast("long")).alias("events")
    )
    left = ordered_prefix(by_time, [], "duration", {"_left": F.col("leaving")}, position="_at", pieces=pieces)
    risk = left.withColumn("at_risk", (F.lit(everyone) - F.coalesce("_left", F.lit(0))).cast("long"))
    share = F.col("events").cast("double") / F.col("at_risk").cast("double")
    risk = risk.select("duration", "at_risk", "events", share.alias("_share"))
    own = {
        "_ended": (F.col("_share") == 1.0).cast("long"),
        "_log": F.when(F.col("_share") < 1.0, F.log1p(-F.col("_share"))).otherwise(F.lit(0.0)),
        "_hazard": F.col("_share"),
    }
    sums = ordered_prefix(risk, [], "duration", own, position="_at", pieces=pieces)
    upto = {c: F.coalesce(F.col(c), F.lit(0)) + own[c] for c in own}
    return sums.select(
        "duration",
        "at_risk",
        "events",
        F.when(upto["_ended"] > 0, F.lit(0.0)).otherwise(F.exp(upto["_log"])).alias("survival"),
        upto["_hazard"].alias("cumulative_hazard"),
    )
