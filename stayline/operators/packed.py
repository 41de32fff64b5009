"""The greatest row per key, kept in one number.

Spark keeps an aggregate in a hash table only if its state has a fixed width. The greatest
of a struct that holds texts has none, so Spark sorts the log for it, and a join back to
the last time moves the log. Here the columns that order rows become digits of one whole
number in mixed radix: numbers and times count from their least value, texts by their
place in a sorted dictionary. The maximum of that number is a hash aggregate with a
map-side part, so a task sends one number per user and no row of the log moves or is
sorted. The digits of the few results are then read back.

One pass before it finds the ranges and the texts. Its groups are the distinct texts, so
it shuffles about as many rows as there are texts. A log that one task sorts at once is
not worth a second pass: below ``WORTH`` bytes, by Spark's own estimate, the struct is
taken, which moves no rows either. Results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stayline.session import stage

#: Estimated bytes of the columns read from which on packing pays for its first pass.
WORTH = 1 << 30
#: Most texts, and most characters in all, of a column's dictionary, which is broadcast.
TEXTS, CHARACTERS = 1 << 18, 1 << 24
#: Numbers that one long holds.
_HALF = 1 << 62


def _number(name: str, kind: T.DataType) -> Column | None:
    """A column as a long in its own order, if it has such a form."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return F.col(name).cast("int" if isinstance(kind, T.BooleanType) else "long").cast("long")
    return None


def _restored(number: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(number)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(number.cast("int"))
    return number.cast(kind)


@dataclass(frozen=True)
class Digit:
    """One column: its least number (texts have places from 0), and one more than its
    greatest code. Code 0 is null, which comes before all values, as it does in structs."""

    name: str
    kind: T.DataType
    least: int
    radix: int

    @property
    def is_text(self) -> bool:
        return isinstance(self.kind, T.StringType)

    def code(self) -> Column:
        at = F.col(_place(self.name)) if self.is_text else _number(self.name, self.kind) - F.lit(self.least)
        return F.coalesce(at + 1, F.lit(0)).cast("long")


def _place(name: str) -> str:
    return f"_at_{name}"


@dataclass(frozen=True)
class Packing:
    """How columns are packed: the digits of the high and of the low half."""

    high: tuple[Digit, ...]
    low: tuple[Digit, ...]
    texts: dict[str, DataFrame]

    def packed(self) -> Column:
        """The number of a row; its order is that of the struct of all columns."""
        high, low = self._half(self.high), self._half(self.low)
        if not self.low:
            return high
        return (high.cast("decimal(19,0)") * F.lit(_HALF).cast("decimal(19,0)")).cast("decimal(38,0)") + low.cast("decimal(19,0)")

    @staticmethod
    def _half(digits: Sequence[Digit]) -> Column:
        number = F.lit(0).cast("long")
        for d in digits:
            number = number * F.lit(d.radix).cast("long") + d.code()
        return number

    def coded(self, df: DataFrame) -> DataFrame:
        """``df`` with the places of its texts. The dictionaries are broadcast: their size is checked."""
        for name, texts in self.texts.items():
            known = texts.select(F.col("text").alias(name), F.col("place").alias(_place(name)))
            df = df.join(F.broadcast(known), name, "left")
        return df

    def unpacked(self, df: DataFrame, number: str) -> DataFrame:
        """The columns of ``df``, ``number`` replaced by the columns it holds."""
        rest = [c for c in df.columns if c != number]
        if self.low:
            wide, half = F.col(number).cast("decimal(38,0)"), F.lit(_HALF).cast("decimal(38,0)")
            df = df.withColumn("_low", (wide % half).cast("long"))
            df = df.withColumn("_high", ((wide - F.col("_low")) / half).cast("long"))
        else:
            df = df.withColumn("_high", F.col(number))
        values = {}
        for half, digits in (("_high", self.high), ("_low", self.low)):
            below = 1
            for d in reversed(digits):
                code = F.expr(f"{half} div {below}") % F.lit(d.radix).cast("long")
                known = F.when(code > 0, code - 1)
                values[_place(d.name) if d.is_text else d.name] = (
                    known if d.is_text else _restored(known + F.lit(d.least), d.kind))
                below *= d.radix
        df = df.select(*rest, *[v.alias(n) for n, v in values.items()])
        for name, texts in self.texts.items():
            known = texts.select(F.col("text").alias(name), F.col("place").alias(_place(name)))
            df = df.join(F.broadcast(known), _place(name), "left")
        return df.select(*rest, *[d.name for d in (*self.high, *self.low)])


def packing(df: DataFrame, columns: Sequence[str]) -> Packing | None:
    """A packing of ``columns``, in the order that ranks them, or None where their values
    do not fit: other types, more texts than a dictionary may hold, or ranges too wide."""
    kinds = {c: df.schema[c].dataType for c in columns}
    texts = [c for c in columns if isinstance(kinds[c], T.StringType)]
    numbers = {c: _number(c, kinds[c]) for c in columns if c not in texts}
    if any(n is None for n in numbers.values()):
        return None
    ranges = [F.struct(F.min(n).alias("least"), F.max(n).alias("most")).alias(c) for c, n in numbers.items()]
    if texts:
        groups = stage(df.groupBy(*texts).agg(F.count("*").alias("_n"), *ranges), "texts")
        ranges = [F.struct(F.min(f"{c}.least").alias("least"), F.max(f"{c}.most").alias("most")).alias(c) for c in numbers]
    else:
        groups = df
    sizes = [x for c in texts for x in (
        F.count_distinct(c).alias(f"n_{c}"), F.sum(F.length(c)).alias(f"chars_{c}"))]
    found = groups.agg(F.lit(0).alias("_"), *ranges, *sizes).first()
    if any(found[f"n_{c}"] > TEXTS or (found[f"chars_{c}"] or 0) > CHARACTERS for c in texts):
        return None
    digits = []
    for c in columns:
        if c in texts:
            digits.append(Digit(c, kinds[c], 0, found[f"n_{c}"] + 1))
        else:
            least, most = found[c]["least"] or 0, found[c]["most"] or 0
            digits.append(Digit(c, kinds[c], least, most - least + 2))
    cut = 0
    while cut < len(digits) and prod(d.radix for d in digits[:cut + 1]) < _HALF:
        cut += 1
    high, low = tuple(digits[:cut]), tuple(digits[cut:])
    if prod(d.radix for d in low) >= _HALF or not high:
        return None
    return Packing(high, low, {c: _dictionary(groups, c) for c in texts})


def _dictionary(groups: DataFrame, name: str) -> DataFrame:
    """(text, place) of a column's texts, in order. Their number has been checked."""
    texts = groups.select(F.col(name).alias("text")).where("text is not null").distinct()
    return texts.withColumn("place", (F.row_number().over(Window.orderBy("text")) - 1).cast("long"))


def _estimated_bytes(df: DataFrame) -> int:
    """What Spark expects the rows to hold; unknown sources count as very large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def greatest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], pack: bool | None = None) -> DataFrame:
    """(keys, columns) of the row per key that is greatest in the order of ``columns``.

    ``pack`` decides between the packed number and the struct; None goes by the size of
    the input. Where the columns cannot be packed the struct is taken anyway: a sort in
    each task instead of a hash table, but still a map-side aggregate that moves no rows.
    """
    wanted = df.select(*keys, *columns)
    if pack is None:
        pack = _estimated_bytes(wanted) >= WORTH
    fitting = packing(wanted, columns) if pack else None
    if fitting is None:
        row = F.max(F.struct(*columns)).alias("_row")
        return wanted.groupBy(*keys).agg(row).select(*keys, *[f"_row.{c}" for c in columns])
    coded = fitting.coded(wanted).select(*keys, fitting.packed().alias("_packed"))
    return fitting.unpacked(coded.groupBy(*keys).agg(F.max("_packed").alias("_packed")), "_packed")
