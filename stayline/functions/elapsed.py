"""Elapsed time and rates.

Days are whole 24-hour units, not calendar days, and every division guards its
divisor because ANSI mode raises on zero.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR


def micros(at: Column) -> Column:
    return F.unix_micros(at)


def _units(span: Column, unit: int) -> Column:
    """floor(span / unit) in exact integer arithmetic."""
    return ((span - F.pmod(span, F.lit(unit))) / F.lit(unit)).cast("long")


def elapsed_micros(start: Column, end: Column) -> Column:
    return micros(end) - micros(start)


def elapsed_days(start: Column, end: Column) -> Column:
    return _units(elapsed_micros(start, end), DAY)


def elapsed_seconds(start: Column, end: Column) -> Column:
    return _units(elapsed_micros(start, end), SECOND)


def seconds_within_day(start: Column, end: Column) -> Column:
    """Seconds left after whole days are taken off."""
    return _units(F.pmod(elapsed_micros(start, end), F.lit(DAY)), SECOND)


def elapsed_hours(start: Column, end: Column) -> Column:
    """Hours at whole-second resolution, as a double."""
    return elapsed_seconds(start, end) / F.lit(3600.0)


def active_days(joined: Column, last_seen: Column) -> Column:
    """The joining day counts as active."""
    return elapsed_days(joined, last_seen) + 1


def ratio(part: Column, whole: Column) -> Column:
    """Double quotient; null where the divisor is zero or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def time_slot(at: Column, width: int) -> Column:
    """Index of the fixed-width slot, in microseconds, that holds an instant."""
    return _units(micros(at), width)
