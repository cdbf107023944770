"""Scalar functions of the business vocabulary, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Period units that periods can begin and end with.
UNITS = ("minute", "hour", "day", "week", "month", "quarter", "year")


def text(value: Column) -> Column:
    return value.cast("string")


def moment(year, month, day, hour=0, minute=0, second=0) -> Column:
    """A time without zone from its parts; null where they name none."""
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (year, month, day, hour, minute, second)]
    return F.call_function("try_make_timestamp_ntz", *parts)


def begin_of_period(when: Column, unit: str) -> Column:
    """The first instant of the unit that holds ``when``; unknown units are refused, not null."""
    if unit not in UNITS:
        raise ValueError(f"unknown period unit {unit}")
    return F.date_trunc(unit, when).cast("timestamp_ntz")


def end_of_period(when: Column, unit: str) -> Column:
    """The last whole second of the unit that holds ``when``."""
    step = {"quarter": "3 MONTH", "week": "7 DAY"}.get(unit, f"1 {unit.upper()}")
    return begin_of_period(when, unit) + F.expr(f"INTERVAL {step}") - F.expr("INTERVAL 1 SECOND")


def if_null(value: Column, other: Column) -> Column:
    return F.coalesce(value, other)


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a, b)


def limited_text(value: Column, length: int) -> Column:
    """A cast to a string of at most ``length`` characters."""
    return F.left(value.cast("string"), F.lit(length))


def number(value: Column, digits: int, places: int) -> Column:
    return value.cast(f"decimal({digits},{places})")
