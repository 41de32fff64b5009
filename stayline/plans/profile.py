"""Per-user profiles for exploration, and the target columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.elapsed import active_days, elapsed_days, ratio
from stayline.operators import clean
from stayline.operators.lookup import attach, latest, play_time, with_campaign

#: What the steps below add for exploration, as each of them says; none of it is modelled.
EXPLORATION_COLUMNS: list[str] = []


def adds(*names: str):
    """Declare the columns of a step, in ``step.names``: the one place where they are named."""
    def declared(step):
        EXPLORATION_COLUMNS.extend(names)
        step.names = names
        return step

    return declared


EVENT_TIEBREAK = ("event_name", "level")
LEVEL_TIEBREAK = ("level",)


@adds("total_play_time")
def with_play_time(users: DataFrame, levels: DataFrame) -> DataFrame:
    return attach(users, play_time(levels, *with_play_time.names))


@adds("last_event_date", "last_action", "last_level_name")
def with_last_event(
    users: DataFrame, events: DataFrame, tiebreak: Sequence[str] = EVENT_TIEBREAK, ties: str = "one"
) -> DataFrame:
    """Add date, action and level of the last event."""
    last = latest(events, ["event_name", "level"], tiebreak, ties)
    return attach(users, last.toDF("user_id", *with_last_event.names))


def _last_seen() -> Column:
    return F.col(with_last_event.names[0])


@adds("active_time_days")
def with_active_days(users: DataFrame) -> DataFrame:
    return users.withColumn(*with_active_days.names, active_days(F.col("date_joined"), _last_seen()))


@adds("data_through", "activity_gap_days")
def with_activity_gap(users: DataFrame, data_through: datetime | str) -> DataFrame:
    """Add the days from the last event to the data pull."""
    day, gap = with_activity_gap.names
    return users.withColumn(day, F.lit(data_through).cast("timestamp")).withColumn(
        gap, elapsed_days(_last_seen(), F.col(day)))


@adds("last_level_played", "last_level_time_s", "last_level_was_practice", "last_level_was_completed")
def with_last_attempt(
    users: DataFrame, levels: DataFrame, tiebreak: Sequence[str] = LEVEL_TIEBREAK, ties: str = "one"
) -> DataFrame:
    """Add name, play time, practice and completion flags of the last level attempt."""
    flagged = levels.withColumn("done", F.col("date_completed").isNotNull())
    read = ["level", "playtime", "practice", "done"]
    last = latest(flagged, read, tiebreak, ties)
    return attach(users, last.select("user_id", *[F.col(c).alias(n) for c, n in zip(read, with_last_attempt.names)]))


@adds("avg_play_time_per_level_s", "daygap", "avg_num_days_per_level")
def with_rates_per_level(users: DataFrame) -> DataFrame:
    """Add average play time per level, days covered and days per level."""
    days, done = active_days(F.col("date_joined"), _last_seen()), F.col("levels_completed")
    values = (ratio(F.col(*with_play_time.names), done), days, ratio(days, done))
    return users.select("*", *[v.alias(n) for v, n in zip(values, with_rates_per_level.names)])


def with_last_level_started(
    users: DataFrame, levels: DataFrame, tiebreak: Sequence[str] = LEVEL_TIEBREAK, ties: str = "one"
) -> DataFrame:
    """Add the last level started, looked up on fully filled, so completed, attempts only."""
    last = latest(clean.complete_rows(levels), ["level"], tiebreak, ties)
    return attach(users, last.select("user_id", F.col("level").alias("last_level_started")))


def with_last_campaign(users: DataFrame, campaigns: DataFrame) -> DataFrame:
    return with_campaign(users, campaigns, "last_level_started", "last_campaign_started")


def with_targets(users: DataFrame, levels: DataFrame, campaigns: DataFrame) -> DataFrame:
    return with_last_campaign(with_last_level_started(users, levels), campaigns)


def user_profile(
    users: DataFrame,
    levels: DataFrame,
    events: DataFrame,
    data_through: datetime | str,
    event_tiebreak: Sequence[str] = EVENT_TIEBREAK,
) -> DataFrame:
    """Users with every exploration column."""
    df = with_play_time(users, levels)
    df = with_last_event(df, events, event_tiebreak)
    df = with_activity_gap(with_active_days(df), data_through)
    df = with_last_attempt(df, levels)
    return with_rates_per_level(df)


# Exploration columns that the draft models keep, and what else they drop.
DRAFT_KEPT = ("last_level_was_practice", "avg_play_time_per_level_s", "avg_num_days_per_level")
DRAFT_ALSO_DROPPED = (
    "id", "date_joined", "age", "last_level_started", "hints_clicked_first_six", "hints_used_first_six",
)


def drop_unmodelled(df: DataFrame) -> DataFrame:
    """Drop what a profile adds, and the sparse survey answers."""
    return df.drop(*EXPLORATION_COLUMNS, *clean.survey_columns(df))


def drop_draft_fields(df: DataFrame) -> DataFrame:
    """The draft models' drop list; columns that are absent are skipped."""
    explored = [c for c in EXPLORATION_COLUMNS if c not in DRAFT_KEPT]
    return df.drop(clean.INDEX_RESIDUE, *explored, *DRAFT_ALSO_DROPPED, *clean.survey_columns(df))


def with_demographics(users: DataFrame) -> DataFrame:
    """Age and country as fixed 0/1 blocks, the English flag, unmodelled columns dropped."""
    df = clean.with_age(users).withColumn(
        "english_speaking", clean.people.english_speaking(F.col("country"))
    )
    df = clean.age_dummies(clean.country_dummies(clean.with_lumped_country(df)))
    return drop_unmodelled(df)
