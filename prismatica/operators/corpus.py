"""Fingerprints of a query corpus, and what is mined from them.  A corpus is a DataFrame (query_id, prompt, sql)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismatica.functions.naming import tokens
from prismatica.operators.statements import statements


def fingerprints(corpus: DataFrame) -> DataFrame:
    """One row for each query, errors as data: the facets of ``statements``, and what mining reads of them."""
    rows = statements(corpus).withColumnRenamed("ctes", "cte_parts")
    return rows.select(
        "*",
        F.transform("cte_parts", lambda c: c["alias"]).alias("ctes"),
        F.transform("created", lambda c: c["alias"]).alias("temp_tables"),
        F.transform("predicates", lambda p: p["column"]).alias("filter_columns"),
        F.transform(F.filter("predicates", lambda p: p["scope"] == 0), lambda p: p["column"]).alias("main_filters"),
        F.size("cases").alias("n_cases"),
    )


def good(prints: DataFrame) -> DataFrame:
    return prints.where("parse_error is null")


def table_queries(prints: DataFrame) -> DataFrame:
    """table, query_id: one row for each table that a query names."""
    return good(prints).select(F.explode("tables").alias("table"), "query_id")


def table_manifest(prints: DataFrame) -> DataFrame:
    """table, query_count: most used first; the queries themselves are the rows of ``table_queries``."""
    return table_queries(prints).groupBy("table").agg(F.count("*").alias("query_count")).orderBy(F.desc("query_count"), "table")


def structural_filters(prints: DataFrame) -> DataFrame:
    """table, cte, column, operator, value: what a CTE filters its source tables by, once each."""
    parts = good(prints).select(F.explode("cte_parts").alias("c")).select("c.alias", "c.filters", F.explode("c.sources").alias("table"))
    return parts.select("table", F.col("alias").alias("cte"), F.explode("filters").alias("f")).select("table", "cte", "f.column", "f.operator", "f.value").distinct()


def _facets() -> Column:
    """What a query says of ``table``, one of its tables: array of (facet, column, function, distinct)."""
    kind = "array<struct<facet:string,column:string,function:string,distinct:boolean>>"

    def of(facet: str, values: Column, column, function=lambda x: F.lit(None), distinct=lambda x: F.lit(False)) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(facet).alias("facet"), column(x).alias("column"), function(x).alias("function"), distinct(x).alias("distinct"))).cast(kind)

    plain = [of(facet, F.col(values), lambda x: x) for facet, values in (("filter", "filter_columns"), ("dimension", "dimensions"), ("cte", "ctes"), ("temp", "temp_tables"))]
    baked = F.flatten(F.transform(F.filter("cte_parts", lambda c: F.array_contains(c["sources"], F.col("table"))), lambda c: c["filters"]))
    # The primary table is joined with the tables of the joins, each of those with the primary one.
    others = F.when(F.col("table") == F.col("primary_table"), F.array_intersect(F.transform("joins", lambda j: j["table"]), "tables")).when(F.exists("joins", lambda j: j["table"] == F.col("table")), F.array("primary_table")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(
        F.concat(
            *plain,
            of("aggregation", F.col("aggregations"), lambda x: x["column"], lambda x: x["function"], lambda x: x["distinct"]),
            of("date", F.col("date_parts"), lambda x: x["column"], lambda x: x["function"]),
            of("structural", baked, lambda x: x["column"]),
            of("joined", F.array_remove(others, F.col("table")), lambda x: x),
            of("query", F.array(F.lit(None).cast("string")), lambda x: x),
        )
    )


def table_context(prints: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Facets of each table over the queries that name it; with metadata (table, coverage) joined and 0 where it is missing.

    The fingerprints are read once.  Facets are rows until they are distinct, so the arrays of a table hold its vocabulary, however many
    queries name it; the facet ``query`` counts them.
    """
    named = good(prints).withColumn("table", F.explode("tables"))
    rows = named.select("table", "n_cases", F.size("joins").alias("n_joins"), F.explode(_facets()).alias("f")).select("table", "n_cases", "n_joins", "f.*")
    rows = rows.groupBy("table", "facet", "column", "function", "distinct").agg(F.count("*").alias("n"), F.sum("n_cases").alias("n_cases"), F.max("n_joins").alias("n_joins"))
    is_query = F.col("facet") == "query"
    gather = lambda facet, value: F.array_sort(F.collect_list(F.when(F.col("facet") == facet, value)))
    context = rows.groupBy("table").agg(
        *[F.max(F.when(is_query, F.col(c))).alias(name) for c, name in (("n", "queries"), ("n_cases", "n_cases"), ("n_joins", "n_joins"))],
        *[gather(f, F.col("column")).alias(n) for f, n in (("filter", "filter_columns"), ("dimension", "dimensions"), ("cte", "ctes"), ("temp", "temp_tables"), ("structural", "structural_columns"), ("joined", "joined_tables"))],
        gather("aggregation", F.struct("function", "column", "distinct")).alias("aggregations"),
        gather("date", F.struct("column", "function")).alias("date_parts"),
    )
    if metadata is not None:
        context = context.join(metadata.select("table", "coverage"), "table", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    return context


def briefs(context: DataFrame) -> DataFrame:
    """table, brief: how a table is connected, as lines of Markdown: tables it is joined with, CTEs and temporary tables that read it, and
    the number of its queries (the queries themselves are the rows of ``table_queries``)."""
    ticked = lambda names: F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")
    line = lambda head, names: F.when(F.size(names) > 0, F.concat(F.lit(f"- {head}: "), ticked(F.col(names))))
    queries = F.concat(F.lit("- Queries: "), F.col("queries").cast("string"))
    return context.select("table", F.concat_ws("\n", line("Joined with", "joined_tables"), line("Read by CTEs", "ctes"), line("Read by temporary tables", "temp_tables"), queries).alias("brief"))


def validator(prints: DataFrame) -> DataFrame:
    """query_id, parses, tables (sorted), join_count, agg_count, has_cte, has_window, complexity; nulls after ``parses`` where it is false.

    Complexity doesn't look at CASEs, as that of ``statements`` does: CTEs, windows or two joins are complex, a join or two aggregates
    medium.  CTEs aren't tables.
    """
    parses = F.col("parse_error").isNull()
    joins, aggregates, has_cte = F.size("joins"), F.size("aggregations"), F.size("cte_parts") > 0
    level = F.when(has_cte | F.col("has_window") | (joins >= 2), "complex").when((joins >= 1) | (aggregates >= 2), "medium").otherwise("simple")
    said = {"tables": F.array_sort("tables"), "join_count": joins, "agg_count": aggregates, "has_cte": has_cte, "has_window": F.col("has_window"), "complexity": level}
    return prints.select("query_id", parses.alias("parses"), *[F.when(parses, c).alias(n) for n, c in said.items()])


def by_view(prints: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Queries with the view of their primary table (mapped by views(table, view), else the table itself); without tables: left out."""
    rows = good(prints).where(F.col("primary_table").isNotNull())
    if views is None:
        return rows.withColumn("view", F.col("primary_table"))
    return rows.join(views.select(F.col("table").alias("primary_table"), "view"), "primary_table", "left").withColumn("view", F.coalesce("view", "primary_table"))


def field_frequency(viewed: DataFrame) -> DataFrame:
    """view, column, n: occurrences as dimension, aggregate argument or filter."""
    uses = F.concat("dimensions", F.filter(F.transform("aggregations", lambda a: a["column"]), lambda c: c.isNotNull()), "filter_columns")
    return viewed.select("view", F.explode(uses).alias("column")).groupBy("view", "column").agg(F.count("*").alias("n"))


def default_filters(viewed: DataFrame, share: float = 0.8) -> DataFrame:
    """view, column, value, share: the most used equality value of a column, where enough of the view's queries have it."""
    total = viewed.groupBy("view").agg(F.count("*").alias("total"))
    used = viewed.select("view", "query_id", F.explode(F.array_distinct("equality_filters")).alias("f")).groupBy("view", "f.column", "f.value").agg(F.countDistinct("query_id").alias("n"))
    best = used.withColumn("place", F.row_number().over(Window.partitionBy("view", "column").orderBy(F.desc("n"), "value"))).where("place = 1")
    return best.join(total, "view").withColumn("share", F.round(F.col("n") / F.col("total"), 4)).where(F.col("n") >= share * F.col("total")).select("view", "column", "value", "share")


def vocabulary(viewed: DataFrame, least: int = 2) -> DataFrame:
    """view, token, column, n: words of prompts with the columns of their queries; kept if seen often, or if the word has one column."""
    columns = F.array_distinct(F.concat("dimensions", F.filter(F.transform("aggregations", lambda a: a["column"]), lambda c: c.isNotNull()), "filter_columns"))
    pairs = viewed.select("view", F.explode(tokens(F.col("prompt"))).alias("token"), columns.alias("columns")).select("view", "token", F.explode("columns").alias("column"))
    counted = pairs.groupBy("view", "token", "column").agg(F.count("*").alias("n"))
    # A word's columns meet in a window, so no table of all words is sent to the driver; words without view are left out.
    choices = F.count("*").over(Window.partitionBy("view", "token"))
    return counted.where("view is not null").withColumn("choices", choices).where((F.col("n") >= least) | (F.col("choices") == 1)).select("view", "token", "column", "n")


def signatures(prints: DataFrame) -> DataFrame:
    """query_id, signature: sorted tables, then sorted joins, of the queries that name at least two tables."""
    written = F.transform("joins", lambda j: F.concat_ws(" ", j["kind"], j["table"], F.concat_ws("=", j["left_key"], j["right_key"])))
    return good(prints).where("size(tables) >= 2").select("query_id", F.concat(F.array_join(F.array_sort("tables"), "|"), F.lit(" / "), F.array_join(F.array_sort(written), ", ")).alias("signature"))


def join_patterns(prints: DataFrame) -> DataFrame:
    """signature, support: most frequent first; the queries themselves are the rows of ``signatures``."""
    return signatures(prints).groupBy("signature").agg(F.count("*").alias("support")).orderBy(F.desc("support"), "signature")


def priorities(prints: DataFrame) -> DataFrame:
    """table, queries, score = queries x (1 + aggregates + CTEs + cases), place by query count.  One row for each table is ranked."""
    context = table_context(prints)
    score = F.col("queries") * (1 + F.size("aggregations") + F.size("ctes") + F.col("n_cases"))
    return context.select("table", "queries", score.cast("bigint").alias("score"), F.row_number().over(Window.orderBy(F.desc("queries"), "table")).cast("bigint").alias("place"))


def per_query(context: DataFrame, prints: DataFrame) -> DataFrame:
    """Facets of tables turned back to the queries that use them."""
    used = table_queries(prints)
    return used.join(context, "table").groupBy("query_id").agg(F.array_sort(F.collect_set("table")).alias("tables"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("filter_columns")))).alias("filter_columns"))


def relevant_columns(prints: DataFrame, cap: int = 50) -> DataFrame:
    """table, columns: filters, aggregate arguments, dimensions and dates in that order, the first ``cap``."""
    uses = F.concat("filter_columns", F.filter(F.transform("aggregations", lambda a: a["column"]), lambda c: c.isNotNull()), "dimensions", F.transform("date_parts", lambda d: d["column"]))
    return table_context(prints).select("table", F.slice(F.array_distinct(uses), 1, cap).alias("columns"))


def sql_columns(table: DataFrame, sample: int = 25, least: float = 0.3) -> DataFrame:
    """column, share: how many of the first non-empty cells look like a query; the best column that reaches ``least``."""
    texts = [f.name for f in table.schema if f.dataType.typeName() == "string"]
    head = table.select(*texts).limit(sample)
    cells = head.unpivot([], texts, "column", "cell").where("cell is not null and trim(cell) <> ''")
    shares = cells.groupBy("column").agg(F.avg(F.col("cell").rlike(r"(?is)\bselect\b.*\bfrom\b").cast("double")).alias("share"))
    return shares.where(F.col("share") >= least).orderBy(F.desc("share"), "column").limit(1)
