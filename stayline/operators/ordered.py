"""Ordered per-key computations that survive a key holding much of the table.

A plain window per user puts a user's whole history into one task. That is fine for all
but the hottest users. Those are found by a count per user; their rows are windowed per
(user, slot), and a small per-slot aggregate carries the state from slot to slot. All full
rows still shuffle once, and results equal those of the plain window. Without a hot user
the plain window is all there is.

A hot user's slots are stretches of time with about ``hot_rows`` rows each. Their borders
are quantiles from a mergeable sketch per hot user, so slots are narrow where the user's
rows are dense: a burst within one second is cut as finely as it takes. No user gets more
than 4096 of them, which bounds what the plan and the driver hold: where the largest has
more rows than that many slots of ``hot_rows``, slots have a 1/4096 of its rows. An instant
that alone holds more than twice a slot's rows becomes a slot of its own, and its rows are
dealt on by sampled ranges of the tiebreak. Both are found from the rows, not asked for.
``slot`` fixes the width in seconds instead, and ``by_range`` cuts every user's rows by
sampled ranges of (keys, time, tiebreak), at the price of a second shuffle and one written
copy of everything, which fixes the ranges for both reads.

Inputs are read up to four times (counts, sketches, rows, hot rows): pass a table from
files, not a long lineage. Rows without a key or a time have no place in the order; they
are kept and get a null result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stayline.functions.elapsed import time_slot
from stayline.operators.skew import HOT_ROWS, filled, hot_keys
from stayline.session import stage

SLOT = "_slot"
HOT = "_hot"
_TIME, _CUTS, _STRETCH = "_time", "_cuts", "_stretch"
#: Ranges that the rows of heavy instants are dealt into, at least, and at most, as many as
#: a key has stretches. The ranks of a sketch with eight entries a stretch are about so exact.
_LEAST_WAYS, _MOST_WAYS = 8, 4096


def _as_number(at: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(at)
    if isinstance(kind, T.DateType):
        return F.unix_date(at).cast("long")
    return F.col(at).cast("long")


def _slot(stretch: Column, part: Column | int = 0) -> Column:
    """Slots order by stretch of time, then by part of an instant."""
    return F.struct(stretch.cast("long").alias("stretch"), (F.lit(part) if isinstance(part, int) else part).alias("part"))


def _astray(at: str, tiebreak: Sequence[str]) -> Column:
    """A slot for rows without a place: spread out, as they may all share the null key."""
    return -1 - F.pmod(F.xxhash64(at, *tiebreak), F.lit(4096))


def _counted_below(df: DataFrame, cuts: str, value: str, most: int, name: str) -> DataFrame:
    """Add how many of the ascending ``cuts`` are at or below ``value``: a binary search of
    one narrow step per halving."""
    df = df.withColumn(name, F.lit(0))
    for step in (1 << k for k in reversed(range(max(most, 1).bit_length()))):
        reached = F.get(cuts, F.col(name) + (step - 1)) <= F.col(value)
        df = df.withColumn(name, F.when(reached, F.col(name) + step).otherwise(F.col(name)))
    return df


def _slot_rows(hot: DataFrame, hot_rows: int) -> int:
    """Rows of a slot: ``hot_rows``, or the part of the largest key that makes _MOST_WAYS."""
    return max(hot_rows, -(-hot.agg(F.max("_n").alias("n")).first()["n"] // _MOST_WAYS))


def stretches(df: DataFrame, keys: Sequence[str], hot: DataFrame, slot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Per hot key the ascending ``_cuts`` between its stretches, and its heavy instants.

    ``df`` has the time as a long, ``_time``. Together they have about one entry per
    ``slot_rows`` rows of the table, which bounds both broadcasts.
    """
    dense = df.join(F.broadcast(hot), list(keys))
    ways = hot.agg(F.max(F.ceil(F.col("_n") / slot_rows)).alias("w")).first()["w"]
    # One text: a column object for each rank takes the driver longer than the job.
    ranks = F.expr(f"array({', '.join(f'{i / ways!r}D' for i in range(1, int(ways)))})")
    sketch = F.kll_sketch_agg_bigint(F.col(_TIME), F.lit(min(65535, max(200, 8 * int(ways)))))
    sketched = dense.groupBy(*keys).agg(sketch.alias("s"), F.count("*").alias("n"))
    quantiles = F.kll_sketch_get_quantile_bigint("s", ranks) if ways > 1 else F.array().cast("array<bigint>")
    # A key with a part of the rows of the largest takes as large a part of the quantiles.
    every = F.greatest(F.floor(ways * slot_rows / F.col("n")), F.lit(1))
    borders = sketched.select(*keys, every.alias("every"), quantiles.alias("q")).select(
        *keys, F.filter("q", lambda x, i: (i + 1) % F.col("every") == 0).alias("q"))
    heavy = stage(hot_keys(dense.drop("_n"), [*keys, _TIME], 2 * slot_rows), "heavy")
    alone = heavy.groupBy(*keys).agg(F.flatten(F.collect_list(F.array(F.col(_TIME), F.col(_TIME) + 1))).alias("own"))
    both = borders.join(alone, list(keys), "left").select(*keys, F.array_sort(F.array_distinct(
        F.concat("q", F.coalesce("own", F.array().cast("array<bigint>"))))).alias(_CUTS))
    return stage(both, "stretches"), heavy


def _dealt(heavy_rows: DataFrame, heavy: DataFrame, keys: Sequence[str], at: str, tiebreak: Sequence[str], slot_rows: int) -> DataFrame:
    """Rows of heavy instants with a ``_part`` that follows the tiebreak."""
    size = heavy.agg(F.sum("_n").alias("n")).first()["n"]
    ways = int(min(_MOST_WAYS, max(_LEAST_WAYS, size // slot_rows + 1)))
    ranged = heavy_rows.repartitionByRange(ways, *keys, at, *tiebreak)
    return stage(ranged.select("*", F.spark_partition_id().alias("_part")), "instants")


def _cut(
    df: DataFrame, keys: Sequence[str], at: str, tiebreak: Sequence[str], slot: int | None,
    by_range: bool, hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, bool]:
    """Add the slot, which follows the order in each key, and whether it needs a carry; and
    say whether any does."""
    if by_range:
        ways = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.repartitionByRange(ways, *keys, at, *tiebreak)
        placed = ranged.select("*", _slot(F.spark_partition_id()).alias(SLOT), F.lit(True).alias(HOT))
        return stage(placed, "ordered"), True
    astray, placed, hot_rows = _astray(at, tiebreak), filled(*keys, at), max(hot_rows, 1)
    hot = stage(hot_keys(df, keys, hot_rows).select(*keys, "_n"), "hot")
    if hot.isEmpty():
        return df.withColumns({
            SLOT: _slot(F.when(placed, F.lit(0)).otherwise(astray)), HOT: F.lit(False)}), False
    if slot is not None:
        marked = df.join(F.broadcast(hot.select(*keys, F.lit(True).alias(HOT))), list(keys), "left")
        stretch = F.when(~placed, astray).when(F.col(HOT), time_slot(F.col(at), slot)).otherwise(F.lit(0))
        return marked.withColumn(SLOT, _slot(stretch)), True
    timed = df.withColumn(_TIME, _as_number(at, df.schema[at].dataType))
    slot_rows = _slot_rows(hot, hot_rows)
    cuts, heavy = stretches(timed.where(placed).select(*keys, _TIME), keys, hot, slot_rows)
    most = cuts.agg(F.max(F.size(_CUTS)).alias("m")).first()["m"]
    marked = timed.join(F.broadcast(cuts), list(keys), "left").withColumn(HOT, F.col(_CUTS).isNotNull())
    # Rules that trace a join key to its source write every step of the search into the next,
    # which names it three times: with 17 steps that fills the driver. A generator ends the trace.
    found = _counted_below(marked, _CUTS, _TIME, most, _STRETCH).drop(_CUTS).withColumn(
        _STRETCH, F.explode(F.array(_STRETCH)))
    stretch = F.when(placed, F.col(_STRETCH)).otherwise(astray)
    if heavy.isEmpty():
        return found.withColumn(SLOT, _slot(stretch)).drop(_STRETCH, _TIME), True
    instants = F.broadcast(heavy.select(*keys, _TIME, F.lit(True).alias("_heavy")))
    split = found.join(instants, [*keys, _TIME], "left")
    light = split.where(F.col("_heavy").isNull()).withColumn(SLOT, _slot(stretch))
    dense = _dealt(split.where("_heavy"), heavy, keys, at, tiebreak, slot_rows).withColumn(
        SLOT, _slot(F.col(_STRETCH), F.col("_part") + 1)).drop("_part")
    return light.unionByName(dense).drop(_STRETCH, _TIME, "_heavy"), True


def _with_carry(inside: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    return inside.join(carry, [*keys, SLOT], "left")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tiebreak: Sequence[str],
    name: str,
    amount: Column | None = None,
    include_current: bool = True,
    slot: int | None = None,
    by_range: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add a running sum of ``amount`` (default: a row count) per key in time order."""
    amount = F.lit(1) if amount is None else amount
    counted = F.when(filled(*keys, at), amount.cast("long"))
    sliced, carried = _cut(df.withColumn("_amount", counted), keys, at, tiebreak, slot, by_range, hot_rows)
    frame = (
        Window.partitionBy(*keys, SLOT)
        .orderBy(at, *tiebreak)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    inside = sliced.withColumn("_inside", F.coalesce(F.sum("_amount").over(frame), F.lit(0)))
    if not carried:
        return inside.withColumn(name, F.when(filled(*keys, at), F.col("_inside"))).select(*df.columns, name)
    earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sliced.where(F.col(HOT)).groupBy(*keys, SLOT)
        .agg(F.sum("_amount").alias("_total"))
        .select(*keys, SLOT, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    )
    placed = F.when(filled(*keys, at), F.col("_inside") + F.coalesce("_before", F.lit(0)))
    return _with_carry(inside, keys, carry).withColumn(name, placed).select(*df.columns, name)


def previous_time(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tiebreak: Sequence[str],
    name: str,
    slot: int | None = None,
    by_range: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the time of the key's preceding row."""
    sliced, carried = _cut(df, keys, at, tiebreak, slot, by_range, hot_rows)
    inside = sliced.withColumn(
        "_inside", F.lag(at).over(Window.partitionBy(*keys, SLOT).orderBy(at, *tiebreak))
    )
    if not carried:
        return inside.withColumn(name, F.when(filled(*keys, at), F.col("_inside"))).select(*df.columns, name)
    carry = (
        sliced.where(F.col(HOT)).groupBy(*keys, SLOT)
        .agg(F.max(at).alias("_last"))
        .select(*keys, SLOT,
                F.lag("_last").over(Window.partitionBy(*keys).orderBy(SLOT)).alias("_before"))
    )
    before = F.when(filled(*keys, at), F.coalesce("_inside", "_before"))
    return _with_carry(inside, keys, carry).withColumn(name, before).select(*df.columns, name)


def sum_below(counts: DataFrame, keys: Sequence[str], value: str, amount: str, name: str) -> DataFrame:
    """Add the sum of ``amount`` over smaller values, for one row per (keys, value).

    Values are cut into even sampled ranges. The carried table has one row per range and
    key met in it, at most the number of ranges plus that of keys, which bounds its
    broadcast.
    """
    sliced, _ = _cut(counts, keys, value, (), None, by_range=True)
    below = Window.partitionBy(*keys, SLOT).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    carry = sliced.groupBy(*keys, SLOT).agg(F.sum(amount).alias("_n")).select(
        *keys, SLOT, F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower")
    )
    inside = sliced.withColumn("_inside", F.coalesce(F.sum(amount).over(below), F.lit(0)))
    return (
        inside.join(F.broadcast(carry), [*keys, SLOT])
        .withColumn(name, F.col("_inside") + F.col("_lower"))
        .select(*counts.columns, name)
    )
