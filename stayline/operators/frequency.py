"""Counts, shares, profiles and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.elapsed import ratio
from stayline.operators.ordered import sum_below
from stayline.session import stage

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def frequencies(df: DataFrame, *columns: str, drop_null: bool = True) -> DataFrame:
    """Rows per value, most frequent first; ties in value order."""
    kept = df.dropna("any", subset=list(columns)) if drop_null else df
    return (
        kept.groupBy(*columns).agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), *columns)
    )


def filled_counts(df: DataFrame, by: str) -> DataFrame:
    """Non-null count of every other column per group, largest group first."""
    others = [c for c in df.columns if c != by]
    return (
        df.where(F.col(by).isNotNull())
        .groupBy(by).agg(*[F.count(c).alias(c) for c in others])
        .orderBy(F.col(others[0]).desc(), by)
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def shares(counts: DataFrame) -> DataFrame:
    """Add each row's share of all counts, largest first.

    The counts are written once, so the table behind them is read once; the total comes as
    a scalar subquery over the counts.
    """
    counted = stage(counts, "counts")
    total = counted.agg(F.sum("n").alias("total")).scalar()
    rest = [c for c in counts.columns if c != "n"]
    return counted.withColumn("share", ratio(F.col("n"), total)).orderBy(F.col("n").desc(), *rest)


def share_of(counts: DataFrame, **sets: Column) -> DataFrame:
    """One row: the share of the total that falls in each named condition."""
    return counts.agg(
        F.sum("n").alias("total"),
        *[
            ratio(F.sum(F.when(condition, F.col("n")).otherwise(0)), F.sum("n")).alias(name)
            for name, condition in sets.items()
        ],
    )


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of numeric columns.

    Quartiles interpolate linearly between ranks. Ranks come from counts per distinct
    value, summed range by range, so no task holds all the values of a column.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    long = df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("value").isNotNull())
    # One row per profiled column.
    stats = long.groupBy("column").agg(
        F.count("*").alias("filled"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    ranked = sum_below(counts, ["column"], "value", "n", "_before").join(F.broadcast(stats), "column")
    picks = []
    for name, share in QUARTILES.items():
        at = (F.col("filled") - 1) * F.lit(share)
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("n"))
            picks.append(F.max(F.when(held, F.col("value"))).alias(f"_{name}_{end}"))
    measures = ("filled", "mean", "std", "min", "max")
    found = ranked.groupBy("column").agg(*[F.max(m).alias(m) for m in measures], *picks)

    def quartile(name: str, share: float) -> Column:
        at = (F.col("filled") - 1) * F.lit(share)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return found.select(
        "column", "filled", "mean", "std", "min", *[quartile(n, s) for n, s in QUARTILES.items()], "max"
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns, and filled cells per column."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.max(F.lit(len(df.columns))).alias("n_columns"),
        *[F.count(c).alias(f"filled_{c}") for c in df.columns],
    )


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float, outside: bool = False) -> DataFrame:
    """Rows per equal-width bin; the top edge is in the last bin.

    Values outside the range go, or with ``outside`` are counted too: below it in bin 0,
    above it in bin ``bins`` + 1, which have one edge each, and nulls and NaN in a null bin.
    """
    x = F.col(column).cast("double")
    low, high = F.lit(float(low)), F.lit(float(high))
    number = F.least(F.width_bucket(x, low, high, F.lit(bins)), F.lit(bins)).cast("int")
    if outside:
        number = F.when(x.isNull() | F.isnan(x), None).when(x < low, 0).when(x > high, bins + 1).otherwise(number)
    width = (high - low) / F.lit(float(bins))
    counts = (df if outside else df.where(x.between(low, high))).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    bin_ = F.col("bin")
    return counts.select(
        "bin", F.when(bin_ > 0, low + width * (bin_ - 1)).alias("bin_from"),
        F.when(bin_ <= bins, low + width * bin_).alias("bin_to"), "n")


def _octave(size: Column) -> Column:
    """The power of two at or below a size above zero; set right where the logarithm rounds."""
    guess = F.floor(F.log2(size))
    return F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(
        F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)


def growing_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal-width bin over whatever range the values have, in one pass.

    Bins start at multiples of a width that is a power of two. The pass counts in cells
    that are narrow where values are small: each octave has the same number of them, at
    least twice ``bins``. Cells of all octaves nest in the bins of any such width as wide
    as the widest cell, so the width is chosen afterwards, from the counts: the least one
    that needs no more than ``bins`` bins. Counts merge by addition, whatever the order,
    and their number depends on the octaves and not on the rows.

    Every row is counted: nulls, NaN and infinite values in a null bin.
    """
    fine = max(bins - 1, 1).bit_length() + 1
    x = F.col("x")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    width = F.pow(F.lit(2.0), F.greatest(_octave(F.abs(x)), F.lit(-1000)) - fine)
    cell = F.when(~finite, None).when(x == 0, F.lit(0.0)).otherwise(F.floor(x / width) * width)
    cells = df.select(F.col(column).cast("double").alias("x")).groupBy(cell.alias("at")).agg(
        F.count("*").alias("n"), F.min(F.when(finite, x)).alias("least"), F.max(F.when(finite, x)).alias("most"))
    # A few thousand rows at most.
    cells = stage(cells, "cells")
    ends = cells.agg(F.min("least").alias("low"), F.max("most").alias("high"))
    size = F.greatest(F.abs("low"), F.abs("high"))
    powers = F.sequence(F.when(size > 0, F.greatest(_octave(size), F.lit(-1000)) - fine).otherwise(F.lit(0)).cast("int"), F.lit(1024))
    two = lambda p: F.pow(F.lit(2.0), p)
    needed = lambda p: F.floor(F.col("high") / two(p)) - F.floor(F.col("low") / two(p)) + 1
    chosen = ends.where(F.col("low").isNotNull()).select(
        two(F.get(F.filter(powers, lambda p: needed(p) <= max(bins, 2)), F.lit(0))).alias("width"), "low")
    joined = cells.join(F.broadcast(chosen), F.col("at").isNotNull(), "left")
    number = F.floor(F.col("at") / F.col("width")) - F.floor(F.col("low") / F.col("width")) + 1
    start = F.floor(F.col("at") / F.col("width")) * F.col("width")
    return joined.groupBy(number.cast("int").alias("bin"), start.alias("bin_from"), (start + F.col("width")).alias("bin_to")).agg(
        F.sum("n").alias("n"))
