"""Joins and counts for tables where one key may hold a large part of all rows.

Spark's own skew handling splits a partition only when both join inputs are plain
shuffles, which an aggregated side is not. So hot keys are found by a count, and only
their rows are salted: the log side by a stable hash, the small side by copies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 1_000_000
HOT_KEYS = 100_000
_SALT = "_salt"
_WAYS = "_ways"
_ASTRAY = 4096


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """(keys, _n): the keys with more than ``rows`` rows, at most the HOT_KEYS largest.

    That bounds the result, so it is safe to broadcast. A key left out holds less than a
    1/HOT_KEYS share of all rows and needs no special treatment.
    """
    return (
        df.dropna("any", subset=list(keys))
        .groupBy(*keys).agg(F.count("*").alias("_n"))
        .where(F.col("_n") > rows)
        .orderBy(F.col("_n").desc(), *keys).limit(HOT_KEYS)
    )


def filled(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def spread_join(
    facts: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a log to a table with few rows per key ("inner", "left" or "left_semi").

    A key with n log rows is dealt to about n / hot_rows tasks. The salt hashes the row
    and the number of its input partition: exact copies part too, and a task that runs
    again deals its rows the same way. Log rows without a key match nothing; they are
    spread as well.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"cannot spread a {how} join")
    ways = F.ceil(F.col("_n") / F.lit(float(max(hot_rows, 1)))).cast("int")
    hot = F.broadcast(hot_keys(facts, keys, hot_rows).select(*keys, ways.alias(_WAYS)))
    deal = F.xxhash64(*facts.columns, F.spark_partition_id())
    salt = F.when(~filled(*keys), -1 - F.pmod(deal, F.lit(_ASTRAY))).otherwise(
        F.pmod(deal, F.coalesce(_WAYS, F.lit(1)))
    )
    dealt = facts.join(hot, list(keys), "left").select(*facts.columns, salt.cast("int").alias(_SALT))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(_WAYS, F.lit(1)) - 1))
    copied = small.join(hot, list(keys), "left").select(*small.columns, copies.alias(_SALT))
    return dealt.join(copied, [*keys, _SALT], how).drop(_SALT)
