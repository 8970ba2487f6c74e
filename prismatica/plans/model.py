"""Semantic models: views with dimensions, time dimensions and measures, and explores that join them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Measure types.
MEASURE_KINDS = ("sum", "count", "count_distinct", "average", "min", "max", "stddev", "variance", "median", "sum_distinct", "average_distinct", "number")


@dataclass(frozen=True)
class Dimension:
    """``sql`` may use ${TABLE} and other fields as ${name} or ${view.name}; ``order_by`` names a hidden field that sorts it."""

    name: str
    sql: str
    kind: str = "string"
    order_by: str | None = None
    hidden: bool = False


@dataclass(frozen=True)
class Measure:
    """An aggregate of ``sql``; kind "number" is an expression over other measures written as ${name}."""

    name: str
    kind: str
    sql: str = "*"
    filters: dict[str, str] = field(default_factory=dict)
    key: str | None = None  # for sum_distinct and average_distinct


@dataclass(frozen=True)
class View:
    """A table, or rows derived from tables (with filters that no request can lift), and its fields."""

    name: str
    table: str | None = None
    derived: Callable[[Callable[[str], DataFrame]], DataFrame] | None = None
    primary_key: str | None = None
    dimensions: tuple[Dimension, ...] = ()
    times: dict[str, str] = field(default_factory=dict)  # dimension group -> sql
    measures: tuple[Measure, ...] = ()


@dataclass(frozen=True)
class Join:
    """``on`` pairs a field expression of what is joined so far with one of the view; relationship is seen from the left."""

    view: str
    on: tuple[tuple[str, str], ...]
    how: str = "left"
    relationship: str = "many_to_one"


@dataclass(frozen=True)
class Explore:
    name: str
    base: str
    joins: tuple[Join, ...] = ()
    always_where: str | None = None
    always_filter: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    views: dict[str, View]
    explores: dict[str, Explore]


@dataclass(frozen=True)
class Request:
    """Fields are view.name, or view.group_timeframe for time dimensions."""

    explore: str
    dimensions: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    filters: dict[str, str] = field(default_factory=dict)
    order: tuple[str, ...] = ()  # "name" or "name desc"
    limit: int | None = None
