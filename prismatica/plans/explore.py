"""The DataFrame that a request against an explore denotes: filter, join, group, aggregate, order; Spark plans the rest."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatica.functions.filter_text import predicate
from prismatica.functions.timeframes import TIMEFRAMES, timeframe
from prismatica.plans.model import Explore, Join, Measure, Model, Request, View

DISTINCT = ("sum_distinct", "average_distinct")
_REF = re.compile(r"\$\{([A-Za-z_][\w.]*)\}")


class Fields:
    """Looks up the fields of the views that a request uses, and resolves references between them."""

    def __init__(self, model: Model, as_of: dt.datetime | None):
        self.model, self.as_of = model, as_of

    def view_of(self, name: str) -> View:
        return self.model.views[name.split(".")[0]]

    def sql(self, name: str, seen: tuple[str, ...] = ()) -> str:
        """SQL of a dimension with all references replaced; a cycle is an error."""
        if name in seen:
            raise ValueError(f"fields refer to each other: {' -> '.join((*seen, name))}")
        view, short = name.split(".", 1)
        found = next((d.sql for d in self.model.views[view].dimensions if d.name == short), None) or self.model.views[view].times.get(short)
        if found is None:
            raise KeyError(f"no field {name}")
        return self.expand(found, view, (*seen, name))

    def expand(self, sql: str, view: str, seen: tuple[str, ...] = ()) -> str:
        return _REF.sub(lambda m: f"`{view}`" if m[1] == "TABLE" else f"({self.sql(m[1] if '.' in m[1] else f'{view}.{m[1]}', seen)})", sql)

    def column(self, name: str) -> tuple[Column, str]:
        """Column and kind of a dimension or of a timeframe of a time dimension."""
        view, short = name.split(".", 1)
        for frame in sorted(TIMEFRAMES, key=len, reverse=True):
            group = short.removesuffix(f"_{frame}")
            if group != short and group in self.model.views[view].times:
                return timeframe(F.expr(self.sql(f"{view}.{group}")), frame), "time"
        if short in self.model.views[view].times:
            return F.expr(self.sql(name)), "time"
        kind = next((d.kind for d in self.model.views[view].dimensions if d.name == short), "string")
        return F.expr(self.sql(name)), kind

    def filter(self, name: str, text: str) -> Column:
        view, short = name.split(".", 1)
        for frame in TIMEFRAMES:  # a filter on a timeframe of a date bounds the date itself
            group = short.removesuffix(f"_{frame}")
            if group != short and group in self.model.views[view].times:
                return predicate(F.expr(self.sql(f"{view}.{group}")), text, "time", self.as_of)
        column, kind = self.column(name)
        return predicate(column, text, kind, self.as_of)


def _used_views(fields: Fields, explore: Explore, request: Request, wanted: list[str]) -> set[str]:
    used = {explore.base, *(n.split(".")[0] for n in (*wanted, *request.filters, *explore.always_filter))}
    texts = [explore.always_where or ""]
    for n in wanted:
        view = fields.view_of(n)
        texts += [d.sql for d in view.dimensions if f"{view.name}.{d.name}" == n] + [m.sql for m in view.measures if f"{view.name}.{m.name}" == n]
    used |= {v for v in fields.model.views if any(re.search(rf"\b{v}\.", t) for t in texts)}
    return used


def _needed_joins(model: Model, explore: Explore, used: set[str]) -> list[Join]:
    """Joins in order, without left many-to-one joins to a view's primary key from which nothing is used."""
    kept: list[Join] = []
    used = set(used)
    for join in reversed(explore.joins):
        key = model.views[join.view].primary_key
        unique = join.relationship in ("many_to_one", "one_to_one") and key is not None and any(key == right for _, right in join.on)
        if join.view in used or join.how != "left" or not unique:
            kept.append(join)
            used |= {left.split(".")[0] for left, _ in join.on}
    return kept[::-1]


def _aggregate(kind: str, x: Column) -> Column:
    made = {"sum": F.sum, "count": F.count, "count_distinct": F.countDistinct, "average": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "variance": F.var_samp, "median": F.median}
    return made[kind](x)


def build(tables: Callable[[str], DataFrame], model: Model, request: Request, as_of: dt.datetime | None = None) -> DataFrame:
    """Rows of the requested dimensions and measures, named by their short names."""
    explore, fields = model.explores[request.explore], Fields(model, as_of)
    measures = [_measure(model, name) for name in request.measures]
    parts = [p for m in measures for p in _parts(model, *m)]
    wanted = [*request.dimensions, *(f"{v}.{m.name}" for v, m in parts)]
    joins = _needed_joins(model, explore, _used_views(fields, explore, request, wanted))

    rows = _source(tables, model.views[explore.base])
    for join in joins:
        on = [F.expr(left) == F.expr(f"`{join.view}`.{right}") for left, right in join.on]
        rows = rows.join(_source(tables, model.views[join.view]), on, join.how)
    for name, text in {**{k: v for k, v in explore.always_filter.items() if k not in request.filters}, **request.filters}.items():
        rows = rows.where(fields.filter(name, text))
    if explore.always_where:
        rows = rows.where(F.expr(fields.expand(explore.always_where, explore.base)))

    sorters = {d: s for d in request.dimensions if (s := _order_field(model, d))}
    keys = {d.split(".", 1)[1]: fields.column(d)[0] for d in request.dimensions}
    keys |= {f"__sort_{d.split('.', 1)[1]}": fields.column(s)[0] for d, s in sorters.items()}
    many = [j for j in joins if j.relationship in ("one_to_many", "many_to_many")]
    one_side = {v for v, m in parts if many and v not in {j.view for j in many}}
    distinct_keys = {fields.expand(m.key, v) for v, m in parts if m.kind in DISTINCT}
    if distinct_keys or one_side:
        grouped = _two_phases(rows, keys, parts, one_side, distinct_keys, model, fields)
    else:
        grouped = rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*_single(parts, fields)) if parts else rows.select(*[c.alias(n) for n, c in keys.items()]).distinct()
    out = [F.expr(_REF.sub(lambda m: f"`{m[1].split('.')[-1]}`", m.sql)).alias(m.name) if m.kind == "number" else F.col(m.name) for _, m in measures]
    visible = [n for n in keys if not n.startswith("__sort_")]
    order = []
    for o in request.order:
        name, _, way = o.partition(" ")
        column = F.col(f"__sort_{name}") if f"__sort_{name}" in keys else F.col(name)
        order.append(column.desc() if way == "desc" else column.asc())
    result = grouped.select(*visible, *[n for n in keys if n not in visible], *out)
    if order:
        result = result.orderBy(*order)
    if request.limit is not None:
        result = result.limit(request.limit)
    return result.drop(*[n for n in keys if n not in visible])


def _source(tables, view: View) -> DataFrame:
    return (view.derived(tables) if view.derived else tables(view.table)).alias(view.name)


def _measure(model: Model, name: str) -> tuple[str, Measure]:
    view, short = name.split(".", 1)
    return view, next(m for m in model.views[view].measures if m.name == short)


def _parts(model: Model, view: str, measure: Measure) -> list[tuple[str, Measure]]:
    """The aggregates that a measure needs: itself, or those that a number measure is written with."""
    if measure.kind != "number":
        return [(view, measure)]
    return [p for ref in dict.fromkeys(_REF.findall(measure.sql)) for p in _parts(model, *_measure(model, ref if "." in ref else f"{view}.{ref}"))]


def _order_field(model: Model, dimension: str) -> str | None:
    view, short = dimension.split(".", 1)
    found = next((d.order_by for d in model.views[view].dimensions if d.name == short), None)
    return f"{view}.{found}" if found else None


def _input(view: str, m: Measure, fields: Fields) -> Column:
    x = F.lit(1) if m.sql == "*" else F.expr(fields.expand(m.sql, view))
    for name, text in m.filters.items():
        x = F.when(fields.filter(f"{view}.{name}", text), x)
    return x


def _single(parts: list[tuple[str, Measure]], fields: Fields) -> list[Column]:
    return list({m.name: _aggregate(m.kind, _input(view, m, fields)).alias(m.name) for view, m in parts}.values())


def _two_phases(rows: DataFrame, keys: dict[str, Column], parts, one_side: set[str], distinct_keys: set[str], model: Model, fields: Fields) -> DataFrame:
    """Measures that count each key once: those of a side that a one-to-many join repeats, and sum_distinct and average_distinct.

    First one row for each key, then the aggregate; all other measures are aggregated in the first phase and combined in the second.
    Both phases are hash aggregations with map-side partial sums; nothing is collected.
    """
    for name in one_side:
        if model.views[name].primary_key is None:
            raise ValueError(f"{name} needs a primary key: its rows repeat under a one-to-many join")
    all_keys = distinct_keys | {f"`{v}`.{model.views[v].primary_key}" for v in one_side}
    if len(all_keys) != 1:
        raise ValueError("measures that count each key once must share the key")
    first, second = [], []
    for owner, m in {m.name: (v, m) for v, m in parts}.values():
        x = _input(owner, m, fields)
        if owner in one_side or m.kind in DISTINCT:
            first.append(F.first(x).alias(m.name))
            second.append(_aggregate({"sum_distinct": "sum", "average_distinct": "average"}.get(m.kind, m.kind), F.col(m.name)).alias(m.name))
        elif m.kind in ("sum", "count", "min", "max"):
            first.append(_aggregate(m.kind, x).alias(m.name))
            second.append(_aggregate("sum" if m.kind == "count" else m.kind, F.col(m.name)).alias(m.name))
        elif m.kind == "average":
            first += [F.sum(x).alias(f"__sum_{m.name}"), F.count(x).alias(f"__count_{m.name}")]
            second.append((F.sum(f"__sum_{m.name}") / F.sum(f"__count_{m.name}")).alias(m.name))
        else:
            raise ValueError(f"{m.kind} of the many side can't be combined")
    once = rows.groupBy(*[c.alias(n) for n, c in keys.items()], F.expr(next(iter(all_keys))).alias("__key")).agg(*first)
    return once.groupBy(*keys).agg(*second) if keys else once.agg(*second)
