"""Descriptive reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayline.functions import people
from stayline.functions.elapsed import elapsed_days, ratio
from stayline.operators import clean, frequency as fq
from stayline.operators.lookup import attach, column_maxima, unpaid_over, with_campaign


def final_level_counts(users: DataFrame) -> DataFrame:
    """Users per final level count."""
    return (
        users.where(F.col("levels_completed").isNotNull())
        .groupBy(F.col("levels_completed").alias("num_levels_completed"))
        .agg(F.count("*").alias("final_num_users"))
    )


def with_running_users(counts: DataFrame) -> DataFrame:
    """Add total, cumulative, remaining and previous users along the level count.

    The unpartitioned window is over distinct level counts. D of them need at least
    D * (D - 1) / 2 completed levels, so their number grows with the square root of the
    level table at most.
    """
    order = Window.partitionBy().orderBy("num_levels_completed")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = counts.withColumn("total_users", F.sum("final_num_users").over(Window.partitionBy()))
    df = df.withColumn("cumulative_balked", F.sum("final_num_users").over(running))
    df = df.withColumn("users_remaining", F.col("total_users") - F.col("cumulative_balked"))
    return df.withColumn(
        "users_previous", F.coalesce(F.lag("users_remaining").over(order), F.col("total_users"))
    )


def drop_off(users: DataFrame) -> DataFrame:
    """The retention curve by final level count."""
    return with_running_users(final_level_counts(users)).withColumn(
        "percent_retained", ratio(F.col("users_remaining"), F.col("users_previous"))
    ).withColumn("percent_balk", F.lit(1.0) - F.col("percent_retained"))


def worst_drops(curve: DataFrame) -> DataFrame:
    return curve.select("num_levels_completed", "percent_balk").orderBy(
        F.col("percent_balk").desc(), "num_levels_completed"
    )


def level_popularity(levels: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Attempts per level with its campaign, null for levels outside the list."""
    counts = levels.where(F.col("level").isNotNull()).groupBy("level").agg(F.count("*").alias("n"))
    return with_campaign(counts, campaigns, "level", "campaign", default=None)


def unpaid_popularity(
    users: DataFrame, levels: DataFrame, campaigns: DataFrame, over: int = 12
) -> DataFrame:
    return level_popularity(unpaid_over(users, levels, over), campaigns)


def of_campaigns(popularity: DataFrame, *campaigns: str) -> DataFrame:
    """Rows of a popularity table that belong to the campaigns."""
    return popularity.where(F.col("campaign").isin(*campaigns))


def days_since_last(levels: DataFrame, today: datetime | str) -> DataFrame:
    """Days from each user's last level attempt to a date."""
    return levels.groupBy("user_id").agg(F.max("created").alias("last_created")).withColumn(
        "days_gap", elapsed_days(F.col("last_created"), F.lit(today).cast("timestamp"))
    )


def _histogram(df: DataFrame, column: str, bins: int, low: float | None, high: float | None, outside: bool) -> DataFrame:
    if low is None or high is None:
        return fq.growing_histogram(df, column, bins)
    return fq.histogram(df, column, bins, low, high, outside)


def inactivity(levels: DataFrame, today: datetime | str, bins: int, low: float | None = None,
               high: float | None = None, outside: bool = False) -> DataFrame:
    """Users by days since their last attempt; without a range, over all there are."""
    return _histogram(days_since_last(levels, today), "days_gap", bins, low, high, outside)


def levels_distribution(users: DataFrame, bins: int, low: float | None = None, high: float | None = None,
                        over: int | None = None, signed_up_only: bool = False, outside: bool = False) -> DataFrame:
    """Users by levels completed; without a range, over all there are."""
    if over is not None:
        users = clean.over_levels(users, over, signed_up_only)
    return _histogram(users, "levels_completed", bins, low, high, outside)


def country_shares(users: DataFrame, over: int = 300) -> DataFrame:
    """One row: share from the US, from English-speaking and from frequent countries."""
    counts = users.groupBy("country").agg(F.count("*").alias("n"))
    country = F.col("country")
    known = country.isNotNull()
    return fq.share_of(
        counts,
        us_share=people.is_in(country, (people.US,)),
        english_share=people.english_speaking(country),
        frequent_share=known & (F.col("n") > over),
    )


def age_shares(users: DataFrame) -> DataFrame:
    """Age buckets among the users that gave one."""
    return fq.shares(fq.frequencies(users, "age"))


def level_mix(numbered: DataFrame, number: int) -> DataFrame:
    """What is played at a given ordinal."""
    return fq.frequencies(numbered.where(F.col("level_num") == number), "level")


def language_mix(levels: DataFrame, names: Sequence[str]) -> DataFrame:
    return fq.frequencies(clean.named_levels(levels, names), "code_language")


def latest_activity(users: DataFrame, events: DataFrame) -> DataFrame:
    """Users with their last event time and greatest action name, latest first."""
    last = column_maxima(events, ["created", "event_name"]).withColumnsRenamed(
        {"max_created": "last_event_date", "max_event_name": "last_action"}
    )
    return attach(users, last).orderBy(F.col("last_event_date").desc_nulls_last(), "id")


def by_outcome(users: DataFrame, *columns: str | Column) -> DataFrame:
    """Users per combination of columns, nulls included."""
    return users.groupBy(*columns).agg(F.count("*").alias("n"))
