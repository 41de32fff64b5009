"""Train and held-out users, event halves, and audits of a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TRAIN, TEST = "train", "test"


def _share(key: Column, share: float, salt: str = "") -> Column:
    """True for about this share of keys, in steps of 1/256, by a stable hash."""
    cut = round(share * 256)
    first_byte = F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 2)
    return F.lit(True) if cut >= 256 else first_byte < F.lit(f"{cut:02x}")


def with_split(
    df: DataFrame, key: str = "id", train: float = 0.75, salt: str = ""
) -> DataFrame:
    """Add ``split``; a user stays on one side in every table and run.

    A second split of one side needs a salt of its own, or every user falls on that side.
    """
    return df.withColumn("split", F.when(_share(F.col(key), train, salt), TRAIN).otherwise(TEST))


#: Rows of one slice of the hash range, ranked by one task.
SLICE_ROWS = 100_000


def class_ranks(df: DataFrame, label: str, key: str = "id", salt: str = "", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``_rank``, from 0, of each row among those of its class by a hash of the key, and
    ``_size``, the rows of the class.

    The hash range is cut into slices of about ``slice_rows`` rows. Rows before a slice are
    known from counts per slice, so a class is never sorted as a whole, however large. Rows
    of one key go by all other columns; a null label is a class, a null key hashes as text.
    """
    digits, total = 1, df.count()
    while 16**digits * slice_rows < total:
        digits += 1
    rest = [c for c in df.columns if c not in (key, label)]
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(salt))
    placed = df.withColumn("_place", F.md5(text)).withColumn("_slice", F.substring("_place", 1, digits))
    counts = placed.groupBy(F.col(label).alias("_class"), F.col("_slice").alias("_of")).agg(F.count("*").alias("_n"))
    within = Window.partitionBy("_class")
    before = F.sum("_n").over(within.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    sums = counts.select("_class", "_of", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(within).alias("_size"))
    inside = F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_place", key, *rest)) - 1
    ranked = placed.withColumn("_inside", inside)
    joined = ranked.join(sums, ranked[label].eqNullSafe(sums["_class"]) & (ranked["_slice"] == sums["_of"]))
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).alias("_rank"), "_size")


def with_class_folds(df: DataFrame, folds: int, label: str = "y", key: str = "id", salt: str = "") -> DataFrame:
    """Add ``fold``: every class is dealt evenly, so its folds differ by one row at most."""
    ranked = class_ranks(df, label, key, salt)
    return ranked.select(*df.columns, (F.col("_rank") % folds).cast("int").alias("fold"))


def with_class_split(df: DataFrame, label: str = "y", key: str = "id", train: float = 0.75, salt: str = "") -> DataFrame:
    """Add ``split``: of every class the given share, to the nearest row, is for training."""
    ranked = class_ranks(df, label, key, salt)
    first = F.col("_rank") < F.round(F.col("_size") * F.lit(float(train)))
    return ranked.select(*df.columns, F.when(first, TRAIN).otherwise(TEST).alias("split"))


def random_split(df: DataFrame, seed: int, train: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Seeded row split; use the hash split where rows of a user must stay together."""
    first, second = df.randomSplit([train, 1.0 - train], seed)
    return first, second


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that together make the table; a null key goes to the second."""
    first = F.coalesce(_share(F.col(key), 0.5), F.lit(False))
    return df.where(first), df.where(~first)


def split_audit(full: DataFrame, train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """One row: users per side, overlap, users on neither side and strays, in one shuffle."""
    sides = {"full": full, "train": train, "test": test}
    tagged = None
    for side, df in sides.items():
        part = df.select(key, F.lit(side).alias("_side"))
        tagged = part if tagged is None else tagged.unionByName(part)
    seen = tagged.groupBy(key).agg(
        *[F.max((F.col("_side") == side).cast("int")).alias(side) for side in sides]
    )
    in_full, in_train, in_test = (F.col(s) == 1 for s in sides)
    return seen.agg(
        F.count_if(in_full).alias("n_full"),
        F.count_if(in_train).alias("n_train"),
        F.count_if(in_test).alias("n_test"),
        F.count_if(in_train & in_test).alias("n_overlap"),
        F.count_if(in_full & ~in_train & ~in_test).alias("n_missing"),
        F.count_if(~in_full).alias("n_stray"),
    )


def overlap(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    return first.select(key).intersect(second.select(key))


def uncovered(full: DataFrame, *parts: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the full table, by key, whose key no part holds."""
    rest = full.select(key)
    for part in parts:
        held = part.select(F.col(key).alias("_held"))
        rest = rest.join(held, rest[key].eqNullSafe(held["_held"]), "left_anti")
    return rest
