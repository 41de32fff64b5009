"""Latest rows, lookups and per-user totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stayline.operators import clean
from stayline.operators.packed import greatest
from stayline.operators.skew import spread_join

OTHER_CAMPAIGN = "other"


def attach(users: DataFrame, per_user: DataFrame) -> DataFrame:
    """Left-join a one-row-per-user frame to users."""
    return users.join(per_user.withColumnRenamed("user_id", "id"), "id", "left")


def latest(
    df: DataFrame,
    columns: Sequence[str],
    tiebreak: Sequence[str] = (),
    ties: str = "one",
    pack: bool | None = None,
) -> DataFrame:
    """The user's last row by ``created``: (user_id, created, columns).

    ``ties="one"`` keeps the greatest tiebreak among rows of the last time, and then the
    greatest returned columns: a map-side maximum per user, so the log is not moved, and
    a large one (or with ``pack``) not sorted either, see ``operators.packed``. ``ties="all"`` keeps every distinct row of the
    last time; only rows at that time meet, by a join on (user, time). Rows without a time
    are not the last.
    """
    if ties not in ("one", "all"):
        raise ValueError("ties must be 'one' or 'all'")
    if ties == "one":
        order = list(dict.fromkeys(["created", *tiebreak, *columns]))
        timed = df.where(F.col("user_id").isNotNull() & F.col("created").isNotNull())
        return greatest(timed, ["user_id"], order, pack).select("user_id", "created", *columns)
    last = df.groupBy("user_id").agg(F.max("created").alias("created"))
    at_last = df.select("user_id", "created", *columns).join(last, ["user_id", "created"], "left_semi")
    return at_last.distinct()


def with_campaign(df: DataFrame, campaigns: DataFrame, level: str, name: str = "campaign",
                  default: str | None = OTHER_CAMPAIGN) -> DataFrame:
    """Add the campaign of a level; levels outside the list get the default.

    A level listed under several campaigns counts for the first by name, so no row
    doubles. The list joins without a hint: Spark broadcasts it when it is small enough.
    """
    dim = campaigns.groupBy(F.col("level").alias(level)).agg(F.min("campaign").alias(name))
    joined = df.join(dim, level, "left")
    if default is not None:
        joined = joined.withColumn(name, F.coalesce(name, F.lit(default)))
    return joined.select(*df.columns, name)


def of_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of the given users, each once."""
    return spread_join(df, users.select(F.col("id").alias("user_id")), ["user_id"], "left_semi")


def unpaid_over(users: DataFrame, levels: DataFrame, over: int = 12) -> DataFrame:
    """Level attempts of unpaid users with more than ``over`` levels."""
    return of_users(levels, clean.over_levels(clean.flagged(users, "paid_subscription", False), over))


def play_time(levels: DataFrame, name: str = "total_play_time") -> DataFrame:
    return levels.groupBy("user_id").agg(F.sum("playtime").alias(name))


def last_of(df: DataFrame, column: str) -> DataFrame:
    """The greatest value of one column per user."""
    return df.groupBy("user_id").agg(F.max(column).alias(column))


def both(first: DataFrame, second: DataFrame) -> DataFrame:
    """Users in both per-user frames, with the columns of each."""
    return first.join(second, "user_id")


def column_maxima(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Independent maxima per user; they need not come from one row.

    Texts are first reduced to the distinct ones per user, a hash aggregate as the other
    maxima are; only those few are then compared.
    """
    texts = [c for c in columns if df.schema[c].dataType == T.StringType()]
    others = [c for c in columns if c not in texts]
    if texts and others:
        df = df.groupBy("user_id", *texts).agg(*[F.max(c).alias(c) for c in others])
    elif texts:
        df = df.select("user_id", *texts).distinct()
    return df.groupBy("user_id").agg(*[F.max(c).alias(f"max_{c}") for c in columns])


def opening_levels(levels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Play time over the named levels, averaged over all of them, and the last completion."""
    return (
        clean.named_levels(levels, names)
        .groupBy("user_id")
        .agg(
            (F.sum("playtime").cast("double") / F.lit(float(len(names)))).alias("avg_first_playtime_s"),
            F.max("date_completed").alias("date_completed_first"),
        )
    )


def one_user(df: DataFrame, user: Column, key: str, at: str) -> DataFrame:
    """One user's rows, newest first."""
    return df.where(F.col(key) == user).orderBy(F.col(at).desc())
