"""Timeframes of time dimensions, and range forms of predicates on parts of dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Timeframes of a time dimension.
TIMEFRAMES = ("raw", "date", "day_of_week", "week", "month", "month_name", "quarter", "year")


def timeframe(column: Column, name: str) -> Column:
    """One timeframe of a timestamp without time zone; numbers are bigint, weeks begin on Monday, Sunday is day 1."""
    if name == "raw":
        return column
    if name == "date":
        return F.to_date(column)
    if name in ("week", "month", "quarter"):
        return F.date_trunc(name, column).cast("date")
    if name == "day_of_week":
        return F.dayofweek(column).cast("bigint")
    if name == "month_name":
        return F.date_format(column, "MMMM")
    if name == "year":
        return F.year(column).cast("bigint")
    raise ValueError(f"no timeframe {name!r}")


def _first_day(year: int, month: int = 1) -> dt.datetime:
    return dt.datetime(year + (month - 1) // 12, (month - 1) % 12 + 1, 1)


def in_period(column: Column, start: dt.datetime, end: dt.datetime) -> Column:
    """Half-open range, which reaches the scan as a pushed filter where year(column) = n would not."""
    literal = lambda t: F.lit(t).cast("timestamp_ntz")
    return (column >= literal(start)) & (column < literal(end))


def in_year(column: Column, year: int) -> Column:
    return in_period(column, _first_day(year), _first_day(year + 1))


def in_month(column: Column, year: int, month: int) -> Column:
    return in_period(column, _first_day(year, month), _first_day(year, month + 1))
