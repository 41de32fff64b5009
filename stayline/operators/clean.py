"""Column clean-up, filters and one-hot blocks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions import people
from stayline.operators.chunks import LANGUAGES
from stayline.operators.skew import spread_join
from stayline.sources.schema import INDEX_RESIDUE

SURVEY_PREFIX = "survey_"
TARGETS = ("levels_completed", "last_level_started", "last_campaign_started")
DEMOGRAPHICS = ("english_speaking", *people.COUNTRY_DUMMIES, *people.AGE_DUMMIES)
EVENT_COLUMNS = ("created", "user_id", "event_name", "level")


def clean_events(df: DataFrame) -> DataFrame:
    """Keep the four used columns (and an event id, if any) and parse the time."""
    extra = [c for c in ("event_id",) if c in df.columns]
    return df.select(_timestamp(df, "created"), *EVENT_COLUMNS[1:], *extra)


def clean_levels(df: DataFrame) -> DataFrame:
    return (
        df.drop(INDEX_RESIDUE)
        .withColumn("created", _timestamp(df, "created"))
        .withColumn("date_completed", _timestamp(df, "date_completed"))
    )


def clean_users(df: DataFrame) -> DataFrame:
    return df.drop(INDEX_RESIDUE).withColumn("date_joined", _timestamp(df, "date_joined"))


def _timestamp(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "string":
        return F.try_to_timestamp(F.col(name)).alias(name)
    return F.col(name).cast("timestamp").alias(name)


def repair_split_header(
    df: DataFrame, head: str, tail: str, following: Sequence[str], joined: str
) -> DataFrame:
    """Undo a header that an unquoted comma cut into ``head`` and ``tail``.

    The cut adds one name, so from ``head`` on every value sits one name too far left:
    ``head`` holds the value of ``joined``, and ``tail`` that of the first following column.
    """
    sources = [head, tail, *following[:-1]]
    moved = dict(zip([joined, *following], sources, strict=True))
    kept = [c for c in df.columns if c not in (head, tail, joined)]
    return df.select(
        *[F.col(f"`{moved.get(c, c)}`").alias(c) for c in kept],
        F.col(f"`{head}`").alias(joined),
    )


def survey_columns(df: DataFrame) -> list[str]:
    """The sparse survey answers among the columns."""
    return [c for c in df.columns if c.startswith(SURVEY_PREFIX)]


def drop_present(df: DataFrame, *names: str) -> DataFrame:
    """Drop the named columns that exist."""
    return df.drop(*names)


def drop_countries(df: DataFrame) -> DataFrame:
    return df.drop(*people.COUNTRY_DUMMIES)


def drop_ages(df: DataFrame) -> DataFrame:
    return df.drop(*people.AGE_DUMMIES)


def split_target(df: DataFrame, target: str) -> DataFrame:
    """Rename the target to ``y`` and drop the other target columns."""
    others = [t for t in TARGETS if t != target]
    return df.drop(*others).withColumnRenamed(target, "y")


def at_least_levels(users: DataFrame, levels: int) -> DataFrame:
    return users.where(F.col("levels_completed") >= levels)


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with no missing value in any column."""
    return df.dropna("any")


def with_age(users: DataFrame) -> DataFrame:
    return users.withColumn("age", people.age_or_other(F.col("age")))


def with_lumped_country(users: DataFrame, kept=people.KEPT_COUNTRIES) -> DataFrame:
    return users.withColumn("country", people.lumped_country(F.col("country"), kept))


def with_frequent_country(users: DataFrame, over: int = 300) -> DataFrame:
    """Lump the countries that have no more than ``over`` users."""
    frequent = (
        users.groupBy("country").agg(F.count("country").alias("_n"))
        .where(F.col("_n") > over)
        .select("country", F.lit(True).alias("_kept"))
    )
    return (
        spread_join(users, frequent, ["country"], "left")
        .withColumn("country", F.when(F.col("_kept"), F.col("country")).otherwise(people.OTHER_COUNTRY))
        .select(*users.columns)
    )


def with_dummies(users: DataFrame, column: str, vocabulary, prefix: str) -> DataFrame:
    """Replace a column by one 0/1 column per vocabulary entry."""
    kept = [c for c in users.columns if c != column]
    return users.select(*kept, *people.one_hot(F.col(column), vocabulary, prefix))


def country_dummies(users: DataFrame) -> DataFrame:
    return with_dummies(users, "country", people.COUNTRY_VOCABULARY, "country")


def age_dummies(users: DataFrame) -> DataFrame:
    return with_dummies(users, "age", people.AGE_VOCABULARY, "age")


def language_dummies(users: DataFrame) -> DataFrame:
    return with_dummies(users, "code_language", LANGUAGES, "code_language")


def majority(share: Column, cut: float = 0.5) -> Column:
    """A share as a flag; a missing share is false."""
    return F.coalesce(share > F.lit(cut), F.lit(False))


def named_levels(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(F.col("level").isin(*names))


def number_range(df: DataFrame, low: int, high: int) -> DataFrame:
    """Level numbers in the half-open range [low, high)."""
    return df.where((F.col("level_num") >= low) & (F.col("level_num") < high))


def numbers_up_to(df: DataFrame, high: int) -> DataFrame:
    return df.where(F.col("level_num") <= high)


def named_events(events: DataFrame, name: str) -> DataFrame:
    return events.where(F.col("event_name") == name)


def flagged(df: DataFrame, column: str, value: bool = True) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def completed(levels: DataFrame) -> DataFrame:
    return levels.where(F.col("date_completed").isNotNull())


def active_after(df: DataFrame, moment: datetime | str) -> DataFrame:
    return df.where(F.col("created") > F.lit(moment).cast("timestamp"))


def over_levels(users: DataFrame, levels: int, signed_up_only: bool = False) -> DataFrame:
    """Users with more than ``levels`` levels."""
    kept = users.where(F.col("levels_completed") > levels)
    return flagged(kept, "signed_up") if signed_up_only else kept


def null_audit(df: DataFrame) -> DataFrame:
    """One row per column: rows, null rows and whether any is null; one pass."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return counts.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(c).alias("nulls"))
                for c in df.columns
            ])
        ).alias("audit")
    ).select(
        "audit.column", "audit.nulls",
        (F.col("audit.rows") - F.col("audit.nulls")).alias("filled"),
        (F.col("audit.nulls") > 0).alias("any_null"),
    )


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
