"""Additive merge of two models that are read from files: ordered views and fields, with a ledger of what was replaced.

Both sides are the rows of ``sources.modelfiles``: views (path, number, view, ...) and fields (path, view, position, ...).  The baseline's
order comes first, then what only the other side has, in its order; the places are given at the end by one window a file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismatica.operators.fields import KEEP_DESCRIPTION

#: Attributes that the other side may add where the baseline has none; all others are the baseline's.
ADDED = ("group_label", "value_format", "value_format_name", "filters", "drill_fields")
#: Kinds of fields that a view of both sides takes from the other side.
MERGED_KINDS = ("dimension", "dimension_group", "measure")
FIELD = ("type", "sql", "label", "description", "tags", "rest", "inner")


@dataclass
class Side:
    """One model: its views, fields, and the faults of its files (path, fault)."""

    views: DataFrame
    fields: DataFrame
    faults: DataFrame


def _empty(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def readable(baseline: Side, enriched: Side) -> tuple[Side, Side, DataFrame]:
    """Both sides without what can't be read, and path, side, taken: which side's file counts where one can't be.

    A baseline that can't be read gives way to the other side; another side that can't be read is left out where there is a baseline.
    """
    broken = lambda side, name: side.faults.select("path").distinct().withColumn(name, F.lit(True))
    has = lambda side, name: side.views.select("path").distinct().withColumn(name, F.lit(True))
    b, e = broken(baseline, "b_bad"), broken(enriched, "e_bad")
    known = b.join(e, "path", "full").join(has(baseline, "b"), "path", "left").join(has(enriched, "e"), "path", "left").na.fill(False)
    taken = F.when(F.col("b_bad") & ~F.col("e_bad"), F.when(F.col("e"), "enriched").otherwise("none")).when(F.col("e_bad") & ~F.col("b_bad"), F.when(F.col("b"), "baseline").otherwise("none")).otherwise("none")
    report = known.select("path", F.when(F.col("b_bad") & F.col("e_bad"), "both").when(F.col("b_bad"), "baseline").otherwise("enriched").alias("unreadable"), taken.alias("taken"))
    # Rows made from few columns are estimated far too small, so these would be broadcast.
    without = lambda side, bad: Side(side.views.join(bad.hint("merge"), "path", "left_anti"), side.fields.join(bad.hint("merge"), "path", "left_anti"), side.faults)
    return without(baseline, b), without(enriched, e), report


def _once(rows: DataFrame, key: list[str], place: str) -> DataFrame:
    """One row for each key: the last one's values at the first one's place."""
    every = Window.partitionBy(*key)
    rows = rows.withColumn("__first", F.min(place).over(every)).withColumn("__n", F.row_number().over(every.orderBy(F.desc(place))))
    return rows.where("__n = 1").withColumn(place, F.col("__first")).drop("__first", "__n")


def merge_views(baseline: DataFrame, enriched: DataFrame) -> DataFrame:
    """path, number, view and the other columns of ``modelfiles.views``: the baseline's views in its order, then new ones.

    A view of both keeps what the baseline says; table, derived SQL, label and description are filled where the baseline's are empty.
    """
    key, filled, kept = ["path", "view"], ["table", "derived", "label", "description"], ["rest", "derived_rest", "inner"]
    b, e = (_once(x.select(*key, "number", *filled, *kept), key, "number").select(*key, F.struct("number", *filled, *kept).alias(s)) for x, s in ((baseline, "b"), (enriched, "e")))
    rows = b.join(e, key, "full")
    order = Window.partitionBy("path").orderBy(F.col("b").isNull(), F.coalesce("b.number", "e.number"))
    return rows.select(
        "path",
        F.row_number().over(order).alias("number"),
        "view",
        *[F.when(_empty(F.col(f"b.{c}")), F.nullif(F.col(f"e.{c}"), F.lit(""))).otherwise(F.col(f"b.{c}")).alias(c) for c in filled],
        *[F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in kept],
    )


def _fields_of_both(baseline: DataFrame, enriched: DataFrame) -> DataFrame:
    key = ["path", "view", "kind", "name"]
    b, e = (_once(x.select(*key, "position", *FIELD), key, "position").select(*key, F.struct("position", *FIELD).alias(s)) for x, s in ((baseline, "b"), (enriched, "e")))
    # Whether the baseline has a field in the view is seen in the joined rows, so the baseline is read once.
    known = F.max(F.col("b").isNotNull()).over(Window.partitionBy("path", "view")) & F.col("path").isNotNull() & F.col("view").isNotNull()
    return b.join(e, key, "full").withColumn("__known", known).where(F.col("b").isNotNull() | ~F.col("__known") | F.col("kind").isin(*MERGED_KINDS)).drop("__known")


def merge_fields(baseline: DataFrame, enriched: DataFrame) -> DataFrame:
    """Fields of both sides, keyed by path, view, kind and name, with ``position`` from 1 in each file and view.

    A field of both keeps the baseline's type, SQL and other attributes.  Tags are united, the baseline's first.  A description of at
    least 30 characters stays, a shorter one gives way to one that isn't empty.  Label and the attributes of ``ADDED`` are filled where
    the baseline's are missing or empty.  A field of one side stays as it is; views of both sides take only dimensions, dimension
    groups and measures from the other side.  Of repeated names the last one counts, at the first one's place.
    """
    rows = _fields_of_both(baseline, enriched)
    both = F.col("b").isNotNull() & F.col("e").isNotNull()
    own = lambda c: F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"e.{c}"))
    short = F.length(F.coalesce(F.trim("b.description"), F.lit(""))) < KEEP_DESCRIPTION
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("b.rest", none), F.coalesce("e.rest", none)
    filled = F.map_filter(new, lambda k, v: k.isin(*ADDED) & _empty(old[k]) & ~_empty(v))
    rest = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(filled, k)), filled)
    order = Window.partitionBy("path", "view").orderBy(F.col("b").isNull(), F.coalesce("b.position", "e.position"))
    tags = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return rows.select(
        "path",
        "view",
        F.row_number().over(order).alias("position"),
        "kind",
        "name",
        own("type").alias("type"),
        own("sql").alias("sql"),
        F.when(both & _empty(F.col("b.label")) & ~_empty(F.col("e.label")), F.col("e.label")).otherwise(own("label")).alias("label"),
        F.when(both & short & ~_empty(F.col("e.description")), F.trim("e.description")).otherwise(own("description")).alias("description"),
        F.array_distinct(F.concat(tags("b.tags"), tags("e.tags"))).alias("tags"),
        F.when(both, rest).otherwise(own("rest")).alias("rest"),
        F.coalesce(own("inner"), F.array().cast("array<string>")).alias("inner"),
    )


def ledger(baseline: DataFrame, enriched: DataFrame) -> DataFrame:
    """path, view, kind, name, was, now: descriptions that the merge replaces because they have under 30 characters."""
    was, now = F.trim("b.description"), F.trim("e.description")
    rows = _fields_of_both(baseline, enriched).where(~_empty(was) & ~_empty(now) & (F.length(was) < KEEP_DESCRIPTION) & (was != now))
    return rows.select("path", "view", "kind", "name", was.alias("was"), now.alias("now"))


def merge(baseline: Side, enriched: Side) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Views and fields of both sides, and the report of files that can't be read."""
    b, e, report = readable(baseline, enriched)
    return merge_views(b.views, e.views), merge_fields(b.fields, e.fields), report
