"""Level numbering and event tagging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stayline.operators.ordered import running_total
from stayline.operators.skew import HOT_ROWS, spread_join


def number_levels(
    levels: DataFrame, tiebreak: Sequence[str] = ("level",), by_range: bool = False,
    slot: int | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``level_num``: 1-based order of the attempt among the user's attempts.

    Attempts at one time go by ``tiebreak`` and then by all other columns, so only equal
    rows may change places.
    """
    rest = [c for c in levels.columns if c not in ("user_id", "created", *tiebreak)]
    return running_total(
        levels, ["user_id"], "created", [*tiebreak, *rest], "level_num", slot=slot, by_range=by_range,
        hot_rows=hot_rows)


def first_numbers(numbered: DataFrame) -> DataFrame:
    """One row per (user, level): the number of the first attempt."""
    return numbered.groupBy("user_id", "level").agg(F.min("level_num").alias("level_num"))


def level_numbers(numbered: DataFrame, fanout: bool = False) -> DataFrame:
    """Numbers to tag events with; ``fanout`` keeps every attempt of a repeated level."""
    if fanout:
        return numbered.select("user_id", "level", "level_num")
    return first_numbers(numbered)


def tag_events(
    events: DataFrame, numbered: DataFrame, fanout: bool = False, where: Column | str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the level number to each event; events without a known level get null.

    Pass a filter on the events as ``where``: it then reaches the scan, which one written
    after this call does not, as the rows are dealt out in between.
    """
    wanted = events if where is None else events.where(where)
    tagged = spread_join(wanted, level_numbers(numbered, fanout), ["user_id", "level"], "left", hot_rows)
    return tagged.select(*events.columns, "level_num")
