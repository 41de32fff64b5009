"""Logins from gaps in activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stayline.functions.elapsed import HOUR, elapsed_hours, time_slot
from stayline.operators.ordered import previous_time
from stayline.operators.skew import HOT_ROWS


def event_gaps(
    events: DataFrame, tiebreak: Sequence[str] = ("event_name", "level"), by_range: bool = False,
    slot: int | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``gap_hours`` to the user's preceding event; null for the first."""
    return (
        previous_time(events, ["user_id"], "created", tiebreak, "_previous", slot=slot, by_range=by_range,
                      hot_rows=hot_rows)
        .withColumn("gap_hours", elapsed_hours(F.col("_previous"), F.col("created")))
        .drop("_previous")
    )


def login_starts(events: DataFrame, threshold_hours: float = 1.0) -> DataFrame:
    """Events that follow a gap of at least the threshold: (user_id, at, previous).

    Time is cut into slots as wide as the threshold. Two neighbours in one slot are
    closer than that, so only the first event of a slot can start a login, and the gap
    before it runs from the last event of the preceding non-empty slot. First and last
    per slot come from a map-side aggregate, which leaves a user at most one row per
    slot however many events it has.
    """
    slot = int(threshold_hours * HOUR)
    presence = (
        events.where(F.col("user_id").isNotNull() & F.col("created").isNotNull())
        .groupBy("user_id", time_slot(F.col("created"), slot).alias("_slot"))
        .agg(F.min("created").alias("at"), F.max("created").alias("_last"))
    )
    by_user = Window.partitionBy("user_id").orderBy("_slot")
    return (
        presence.withColumn("previous", F.lag("_last").over(by_user))
        .where(elapsed_hours(F.col("previous"), F.col("at")) >= F.lit(float(threshold_hours)))
        .select("user_id", "at", "previous")
    )


def count_logins(
    spans: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    name: str = "logins",
    threshold_hours: float = 1.0,
) -> DataFrame:
    """The number of logins inside each span, both ends included: (keys, name).

    The event before the gap must lie in the span too, so the first event of a span
    never counts. ``keys`` identify a span and contain ``user_id``.
    """
    starts = login_starts(events, threshold_hours).withColumnRenamed("user_id", "_user")
    inside = (
        (F.col("user_id") == F.col("_user"))
        & (F.col("previous") >= F.col("_from"))
        & (F.col("at") <= F.col("_to"))
    )
    return (
        spans.select(*keys, F.col(start).alias("_from"), F.col(end).alias("_to"))
        .join(starts, inside, "left")
        .groupBy(*keys)
        .agg(F.count("at").alias(name))
    )
