"""The shape of JSON texts: what stands at each path, over all rows, in one pass and one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the top that are looked into; what lies deeper counts with the object or array that holds it.
DEPTH = 6


def _kind(value: Column) -> Column:
    """object, array, string, int, float, bool or null."""
    said = F.schema_of_variant(value)
    return (
        F.when(said.startswith("OBJECT"), "object")
        .when(said.startswith("ARRAY"), "array")
        .when(said == "STRING", "string")
        .when(said == "BIGINT", "int")
        .when(said == "BOOLEAN", "bool")
        .when(said == "VOID", "null")
        .otherwise("float")
    )


def _elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _inside(node: Column) -> Column:
    """The values right below a node, with their paths; null below what is neither object nor array."""
    child = lambda step, v: F.struct(F.concat(node["path"], step).alias("path"), v.alias("value"), _kind(v).alias("kind"))
    members = F.transform(F.map_entries(_members(node["value"])), lambda e: child(F.concat(F.lit("."), e["key"]), e["value"]))
    elements = F.transform(_elements(node["value"]), lambda v: child(F.lit("[]"), v))
    return F.when(node["kind"] == "object", members).when(node["kind"] == "array", elements)


def nodes(rows: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """path, kind, size, elements: one row for each value at any path of each text.

    ``$`` is the text's own value, ``.key`` a member and ``[]`` an element.  ``size`` counts an object's members or an array's elements;
    ``elements`` says which kinds an array holds: empty, a kind, or several joined by commas.  A null text has kind ``missing``, one that
    isn't JSON ``invalid``.  A text's values are one array while they are listed, so a row is as large as its text.
    """
    value = F.try_parse_json(F.col(column).cast("string"))
    kind = F.when(F.col(column).isNull(), "missing").when(value.isNull(), "invalid").otherwise(_kind(value))
    level = rows.select(F.struct(F.lit("$").alias("path"), value.alias("value"), kind.alias("kind")).alias("top")).select(F.array("top").alias("level0"))
    for k in range(depth):
        level = level.withColumn(f"level{k + 1}", F.flatten(F.filter(F.transform(f"level{k}", _inside), lambda x: x.isNotNull())))
    found = level.select(F.explode(F.concat(*[f"level{k}" for k in range(depth + 1)])).alias("n")).select("n.*")
    size = F.when(F.col("kind") == "object", F.size(_members(F.col("value")))).when(F.col("kind") == "array", F.size(_elements(F.col("value"))))
    held = F.array_join(F.array_sort(F.array_distinct(F.transform(_elements(F.col("value")), _kind))), ",")
    return found.select("path", "kind", size.alias("size"), F.when(F.col("kind") == "array", F.when(size == 0, "empty").otherwise(held)).alias("elements"))


def shapes(rows: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """path, n, kinds, least_size, most_size, elements, mixed: what stands at each path of all texts.

    ``kinds`` and ``elements`` are the different ones, sorted and joined by commas and bars.  ``mixed`` tells whether values of more than
    one kind, nulls apart, stand there, or an array holds several.  Everything is merged as sets, minima and counts, so texts can be
    taken in any order and in parts.
    """
    found = nodes(rows, column, depth).groupBy("path").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.min("size").cast("long").alias("least_size"),
        F.max("size").cast("long").alias("most_size"),
        F.array_sort(F.collect_set("elements")).alias("elements"),
    )
    several = (F.size(F.array_except("kinds", F.array(F.lit("null"), F.lit("missing")))) > 1) | F.exists("elements", lambda e: F.contains(e, F.lit(",")))
    return found.select("path", "n", F.array_join("kinds", ",").alias("kinds"), "least_size", "most_size", F.array_join("elements", "|").alias("elements"), several.alias("mixed"))
