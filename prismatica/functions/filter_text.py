"""Filter values as texts ("Consumer", ">0", "2024", "last 12 months") turned into predicates."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismatica.functions.timeframes import _first_day, in_period, in_year

_COMPARE = {">=": "__ge__", "<=": "__le__", "!=": "__ne__", "<>": "__ne__", ">": "__gt__", "<": "__lt__", "=": "__eq__"}


def _number(text: str) -> float:
    """The number that a filter text says; one that can't be read would match nothing without a word, so it is an error."""
    try:
        return float(text)
    except ValueError:
        raise ValueError(f"not a number in a filter: {text.strip()!r}") from None


def predicate(column: Column, text: str, kind: str = "string", as_of: dt.datetime | None = None) -> Column:
    """The predicate that a filter text denotes on a dimension of the kind string, number, yesno or time.

    Relative periods end with the day of ``as_of``, which they need.  Commas separate alternatives; a leading minus excludes.
    """
    text = text.strip()
    if kind == "yesno":
        return column == F.lit(text.lower() in ("yes", "true"))
    if kind == "time":
        return _period(column, text, as_of)
    m = re.match(r"(>=|<=|!=|<>|>|<|=)\s*(.+)$", text)
    if m:
        return getattr(column, _COMPARE[m[1]])(F.lit(_number(m[2]) if kind == "number" else m[2]))
    if kind == "number":
        m = re.match(r"\[?\s*(-?[\d.]+)\s*(?:to|,)\s*(-?[\d.]+)\s*\]?$", text)
        if m:
            return column.between(float(m[1]), float(m[2]))
        return column.isin(*[_number(x) for x in text.split(",")])
    parts = [p.strip() for p in text.split(",")]
    wanted, unwanted = [p for p in parts if not p.startswith("-")], [p[1:] for p in parts if p.startswith("-")]
    found = _any(column, wanted) if wanted else F.lit(True)
    return found & ~_any(column, unwanted) if unwanted else found


def _any(column: Column, values: list[str]) -> Column:
    """Equality with any value; % stands for any characters."""
    plain = [v for v in values if "%" not in v]
    out = column.isin(*plain) if plain else F.lit(False)
    for v in values:
        if "%" in v:
            out = out | column.like(v)
    return out


def _period(column: Column, text: str, as_of: dt.datetime | None) -> Column:
    if re.fullmatch(r"\d{4}", text):
        return in_year(column, int(text))
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", text)
    if m:
        day = dt.datetime(*map(int, m.groups()))
        return in_period(column, day, day + dt.timedelta(days=1))
    m = re.fullmatch(r"last(?:\s+(\d+))?\s+(day|week|month|quarter|year)s?", text.lower())
    if not m or as_of is None:
        raise ValueError(f"no period {text!r}" if as_of is not None or not m else "a relative period needs as_of")
    day = dt.datetime(as_of.year, as_of.month, as_of.day)
    n, unit = m[1], m[2]
    if n is None:  # the last complete unit
        if unit in ("month", "quarter", "year"):
            months = {"month": 1, "quarter": 3, "year": 12}[unit]
            end = _first_day(day.year, (day.month - 1) // months * months + 1)
            return in_period(column, _back(end, months), end)
        start = day - dt.timedelta(days=day.weekday()) if unit == "week" else day
        return in_period(column, start - dt.timedelta(days=7 if unit == "week" else 1), start)
    end = day + dt.timedelta(days=1)
    days = {"day": 1, "week": 7}.get(unit)
    start = end - dt.timedelta(days=int(n) * days) if days else _back(end, int(n) * {"month": 1, "quarter": 3, "year": 12}[unit])
    return in_period(column, start, end)


def _back(day: dt.datetime, months: int) -> dt.datetime:
    """The same day so many months before, or the last of that month."""
    first = _first_day(day.year, day.month - months)
    last = _first_day(first.year, first.month + 1) - dt.timedelta(days=1)
    return first.replace(day=min(day.day, last.day))
