"""Types of text columns nobody has declared, found from all of their values.

Types form a lattice: a boolean, a whole number or a time is a text, a whole number is a
double, and nothing (no value at all) is every type. A column's type is the least one that
all its values share. Each value has a set of types it can be read as; those sets meet
over all rows by counting, so one aggregate over the table finds every column's type,
whatever the order of the rows and however many columns there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: From narrow to wide; the first that reads every value is taken. Text reads all.
KINDS = ("boolean", "bigint", "double", "timestamp")
_DIGITS = r"^[+-]?[0-9]{1,18}$"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"


def _text(name: str) -> Column:
    """A value without blanks around it; an empty one is no value."""
    return F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))


def _reads(text: Column) -> dict[str, Column]:
    """Which types a value can be read as. Numbers with a leading zero, such as codes, are
    text, as reading them would lose it."""
    code = text.rlike(r"^[+-]?0[0-9]")
    return {
        "boolean": F.lower(text).isin("true", "false"),
        "bigint": text.rlike(_DIGITS) & ~code,
        "double": text.rlike(_NUMBER) & ~code,
        "timestamp": text.rlike(_TIME) & F.try_to_timestamp(text).isNotNull(),
    }


def column_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The least type of each text column, in one aggregate. Columns without a value are text."""
    if not columns:
        return {}
    counts = []
    for k, name in enumerate(columns):
        text = _text(name)
        counts.append(F.count(text).alias(f"n{k}"))
        counts += [F.count_if(text.isNotNull() & read).alias(f"{kind}{k}") for kind, read in _reads(text).items()]
    row = df.agg(*counts).first()
    return {
        name: next((kind for kind in KINDS if row[f"n{k}"] and row[f"{kind}{k}"] == row[f"n{k}"]), "string")
        for k, name in enumerate(columns)
    }


def with_types(df: DataFrame, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the text columns under their own types; text stays as it is given.

    Pass ``types`` found on other rows (such as the training side) to read both alike:
    values that those types cannot hold become null.
    """
    found = column_types(df, columns) if types is None else types

    def read(out: DataFrame, name: str) -> DataFrame:
        kind = found.get(name, "string")
        return out if kind == "string" else out.withColumn(name, F.try_to_timestamp(_text(name)) if kind == "timestamp" else _text(name).try_cast(kind))

    return reduce(read, columns, df)
