"""Profiles of tables: schema, distinct values, column summaries, JSON shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Types whose distinct values are listed, and how many at most.
LOW_CARDINALITY = ("string", "boolean", "integer", "bigint", "long")
MOST_VALUES = 50


def schema_rows(table: DataFrame) -> DataFrame:
    """position, column, type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(table.schema, 1)]
    return table.sparkSession.createDataFrame(rows, "position bigint, column string, type string, nullable boolean")


def eligible_columns(table: DataFrame) -> list[str]:
    """Columns of a low-cardinality type that aren't named like an id."""
    return [f.name for f in table.schema if f.dataType.typeName() in LOW_CARDINALITY and not f.name.lower().endswith(("_id", "_uuid", "_xref_id"))]


def distinct_values(table: DataFrame, columns: list[str] | None = None, most: int = MOST_VALUES) -> DataFrame:
    """column, values (sorted, the first ``most``), truncated: by one pass over the table for all columns.

    Values are counted by a grouped aggregation of (column, value) pairs with map-side partial sums, so no task sees one column's rows.
    """
    columns = eligible_columns(table) if columns is None else columns
    cells = table.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null").distinct()
    ranked = cells.withColumn("n", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("n") <= most + 1)
    return ranked.groupBy("column").agg(F.array_join(F.slice(F.array_sort(F.collect_list("value")), 1, most), "|").alias("values"), (F.count("*") > most).alias("truncated"))


def column_summary(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, non_empty, distinct_count, avg_length (one digit), max_length over trimmed texts."""
    columns = columns or table.columns
    cells = table.select([F.trim(F.col(f"`{c}`").cast("string")).alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value <> ''")
    return cells.groupBy("column").agg(
        F.count("*").alias("non_empty"), F.countDistinct("value").alias("distinct_count"), F.round(F.avg(F.length("value")), 1).alias("avg_length"), F.max(F.length("value")).cast("bigint").alias("max_length")
    )


#: So many first values of a column are shown, each with so many characters at most.
FIRST_VALUES, SHOWN = 12, 80


def table_summary(table: DataFrame, place: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """position, column, type, nullable, non_empty, distinct_count, first_values, avg_length (one digit), max_length: every column once.

    Texts are trimmed, and empty ones don't count.  ``first_values`` are the first twelve different values in the order of ``place`` (or
    else in the order of the files' rows), cut to 80 characters with an ellipsis.  Cells meet as (column, value) with their first place
    and their number, which partial sums reduce before the shuffle; each task then keeps its twelve first values only.  Columns without
    values have none, and null lengths.
    """
    columns = columns or [c for c in table.columns if c != place]
    order = F.col(f"`{place}`") if place else F.monotonically_increasing_id()
    text = [F.trim(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(columns)]
    names = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(f"c{i}"), F.lit(c))])
    cells = table.select(order.alias("place"), *text).unpivot(["place"], [f"c{i}" for i in range(len(columns))], "key", "value").where("value <> ''")
    values = cells.groupBy("key", "value").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    size = F.length("value")
    counted = values.groupBy("key").agg(F.sum("n").alias("non_empty"), F.count("*").alias("distinct_count"), F.round(F.sum(F.col("n") * size) / F.sum("n"), 1).alias("avg_length"), F.max(size).cast("bigint").alias("max_length"))
    first = values.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("place", "value"))).where(F.col("rank") <= FIRST_VALUES)
    cut = F.when(size > SHOWN, F.concat(F.substring("value", 1, SHOWN - 1), F.lit("…"))).otherwise(F.col("value"))
    first = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", cut.alias("value")))), lambda x: x["value"]).alias("first_values"))
    found = counted.join(first, "key").withColumn("column", names[F.col("key")]).drop("key")
    rows = schema_rows(table).where(F.col("column").isin(columns)).join(found, "column", "left")
    none = F.array().cast("array<string>")
    return rows.select("position", "column", "type", "nullable", F.coalesce("non_empty", F.lit(0)).alias("non_empty"), F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), F.coalesce("first_values", none).alias("first_values"), "avg_length", "max_length")


def json_keys(table: DataFrame, column: str) -> DataFrame:
    """key, n, total: how often each top-level key stands in JSON objects, and the sum of its numeric values."""
    pairs = table.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("try_cast(value AS double)")), 2).alias("total"))
