"""Deterministic proposals for semantic models: from what a corpus says about tables to fields, risks, approvals and gates, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatica.functions import naming
from prismatica.operators.fields import status

#: Measure types of aggregate functions; a distinct count is a type of its own.
MEASURE_TYPES = {"SUM": "sum", "COUNT": "count", "AVG": "average", "MIN": "min", "MAX": "max", "STDDEV": "number", "VARIANCE": "number"}
#: Kinds of change that need a person's approval, and the limit of the planning gate.
STRUCTURAL = ("primary_key", "dimension_group", "derived_table", "case_dimension")
MOST_TOKENS = 800_000


def _field(kind: str, name: Column, type_: Column, sql: Column) -> list[Column]:
    return ["table", F.lit(kind).alias("kind"), name.alias("name"), type_.alias("type"), sql.alias("sql")]


def propose_fields(context: DataFrame, columns: DataFrame) -> DataFrame:
    """table, kind, name, type, sql: proposed fields of each table.

    ``context`` has (table, filter_columns, dimensions, aggregations, date_parts, ctes); ``columns`` has (table, name, type) of the
    warehouse.  Dates become dimension groups; of the other columns, those that are only aggregated become measures alone; every
    aggregate of a column becomes one measure; every CTE a derived table.
    """
    c = context.select("table", "filter_columns", "dimensions", "aggregations", "ctes", F.array_distinct(F.transform("date_parts", lambda d: d["column"])).alias("dates"))
    measured = F.filter(F.transform("aggregations", lambda a: a["column"]), lambda x: x.isNotNull())
    plain = c.select("table", F.explode(F.array_except(F.array_except(F.array_distinct(F.concat("filter_columns", "dimensions")), F.col("dates")), measured)).alias("name"))
    typed = plain.join(columns.select("table", "name", F.col("type").alias("warehouse")), ["table", "name"], "left")
    dims = typed.select(*_field("dimension", F.col("name"), naming.dimension_type(F.coalesce("warehouse", F.lit("STRING"))), F.concat(F.lit("${TABLE}."), F.col("name"))))
    dates = c.select("table", F.explode("dates").alias("d")).select(*_field("dimension_group", naming.dimension_group_name(F.col("d")), F.lit("time"), F.concat(F.lit("${TABLE}."), F.col("d"))))
    types = F.create_map(*[F.lit(x) for pair in MEASURE_TYPES.items() for x in pair])
    used = c.select("table", F.explode("aggregations").alias("a")).where("a.column is not null")
    kind = F.when((F.col("a.function") == "COUNT") & F.col("a.distinct"), "count_distinct").otherwise(types[F.col("a.function")])
    measures = used.select(*_field("measure", naming.measure_name(kind, F.col("a.column")), kind, F.concat(F.lit("${TABLE}."), F.col("a.column"))))
    derived = c.select("table", F.explode("ctes").alias("c")).select(*_field("derived_table", F.concat("c", F.lit("_dt")), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return dims.unionByName(dates).unionByName(measures).unionByName(derived).distinct()


def plan_complexity(context: DataFrame) -> DataFrame:
    """table, complexity: twice the derived tables, plus joins, plus one for any CASE."""
    score = F.size("ctes") * 2 + F.col("n_joins") + F.when(F.col("n_cases") > 0, 1).otherwise(0)
    return context.select("table", F.when(score == 0, "simple").when(score <= 3, "medium").otherwise("complex").alias("complexity"))


def changes(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed fields that a model doesn't have yet, with their risk."""
    new = proposed.join(existing.select("table", "kind", "name"), ["table", "kind", "name"], "left_anti")
    return new.select("table", "kind", "name", F.when(F.col("kind").isin(*STRUCTURAL), "structural").otherwise("low").alias("risk"))


def auto_approved(changed: DataFrame) -> DataFrame:
    """table, n_changes, auto_approved: tables with changes, none of them structural."""
    return changed.groupBy("table").agg(F.count("*").alias("n_changes"), (F.count_if(F.col("risk") == "structural") == 0).alias("auto_approved"))


def approvals(reviews: DataFrame) -> DataFrame:
    """table, decision, feedback from review texts: the last ticked box decides; without one the review is pending."""
    ticked = F.regexp_extract_all("text", F.lit(r"(?m)^\s*[-*]\s*\[[xX]\]\s*(APPROVED|REJECTED)"), F.lit(1))
    feedback = F.trim(F.regexp_extract("text", r"(?is)feedback:\s*(.*)$", 1))
    return reviews.select("table", F.when(F.size(ticked) > 0, F.lower(F.element_at(ticked, -1))).otherwise("pending").alias("decision"), feedback.alias("feedback"))


def approval_gate(plans: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: status, blocking, warnings.  Undecided plans and rejections without feedback block; few approvals warn."""
    rows = plans.select("table").distinct().join(decided, "table", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
    counted = rows.agg(
        F.count_if(F.col("decision") == "pending").alias("pending"),
        F.count_if((F.col("decision") == "rejected") & (F.coalesce("feedback", F.lit("")) == "")).alias("mute"),
        F.count_if(F.col("decision") == "approved").alias("approved"),
        F.count("*").alias("n"),
    )
    blocking = F.array_compact(F.array(F.when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" pending"))), F.when(F.col("mute") > 0, F.concat(F.col("mute").cast("string"), F.lit(" rejected without feedback")))))
    warnings = F.array_compact(F.array(F.when(F.col("approved") * 2 < F.col("n"), "under half approved")))
    return counted.select(status(blocking, warnings).alias("status"), F.array_join(blocking, "; ").alias("blocking"), F.array_join(warnings, "; ").alias("warnings"))


def planning_gate(tables: DataFrame, proposed: DataFrame, tokens: DataFrame) -> DataFrame:
    """table, fault: tables without a dimension or measure; and one row without a table if the tokens are too many."""
    useful = proposed.where(F.col("kind").isin("dimension", "measure")).select("table").distinct()
    bare = tables.select("table").distinct().join(useful, "table", "left_anti").select("table", F.lit("no dimension or measure").alias("fault"))
    much = tokens.agg(F.sum("tokens").alias("n")).where(F.col("n") > MOST_TOKENS).select(F.lit(None).cast("string").alias("table"), F.lit("too many tokens").alias("fault"))
    return bare.unionByName(much)


def join_cycles(prints: DataFrame) -> DataFrame:
    """query_id, table: joins of the outermost query that come back to a table already joined, from one that isn't yet.

    One fold over a query's joins in their order, with the set of what was visited before each.
    """
    names = lambda j: F.array(F.coalesce(j["left_table"], F.lit("")), F.coalesce(j["table"], F.lit("")))
    nothing = F.array().cast("array<string>")

    def step(a, j):
        back = F.array_contains(a["visited"], names(j)[1]) & ~F.array_contains(a["visited"], names(j)[0])
        return F.struct(F.array_union(a["visited"], names(j)).alias("visited"), F.when(back, F.concat(a["back"], F.array(names(j)[1]))).otherwise(a["back"]).alias("back"))

    ordered = F.array_sort(F.filter("joins", lambda j: j["main"]))
    folded = F.aggregate(ordered, F.struct(nothing.alias("visited"), nothing.alias("back")), step, lambda a: a["back"])
    return prints.where("parse_error is null").select("query_id", F.explode(F.array_distinct(folded)).alias("table"))


def discovery_gate(prints: DataFrame, metadata: DataFrame, least: float = 0.5, known: DataFrame | None = None) -> DataFrame:
    """subject, level, finding: what stands against going on with a corpus.

    Unreadable queries, CTEs that read no table and no other CTE, and tables of which less than ``least`` is described, warn.  CTEs
    without body, join cycles, and sources of CTEs that aren't among the ``known`` tables (if given), block.
    """
    good = prints.where("parse_error is null")
    say = lambda rows, subject, level, finding: rows.select(subject.cast("string").alias("subject"), F.lit(level).alias("level"), (finding if not isinstance(finding, str) else F.lit(finding)).alias("finding"))
    used = good.select(F.explode("tables").alias("table")).distinct()
    poor = used.join(metadata, "table", "left").where(F.coalesce("coverage", F.lit(0.0)) < least)
    ctes = good.select("query_id", F.explode("cte_parts").alias("c")).select("query_id", "c.*")
    empty = F.trim("body") == ""
    out = say(prints.where("parse_error is not null"), F.col("query_id"), "warn", F.col("parse_error"))
    for more in (
        say(poor, F.col("table"), "warn", "few columns are described"),
        say(ctes.where(empty), F.col("query_id"), "block", F.concat(F.lit("no body of CTE "), "alias")),
        say(ctes.where(~empty & (F.size("sources") == 0) & (F.size("upstream") == 0)), F.col("query_id"), "warn", F.concat(F.lit("nothing is read by CTE "), "alias")),
        say(join_cycles(prints), F.col("query_id"), "block", F.concat(F.lit("joins come back to "), "table")),
    ):
        out = out.unionByName(more)
    if known is not None:
        sources = ctes.select("alias", F.explode("sources").alias("table")).distinct().join(known.select("table").distinct(), "table", "left_anti")
        out = out.unionByName(say(sources, F.col("table"), "block", F.concat(F.lit("not known, but read by CTE "), "alias")))
    return out


def sections(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """table, section: second-level sections of Markdown texts that name a table."""
    parts = texts.select(F.explode(F.split("text", r"(?m)^(?=## )")).alias("section")).where("section like '## %'")
    words = parts.select("section", F.explode(F.array_distinct(F.regexp_extract_all("section", F.lit(r"(\w+)"), F.lit(1)))).alias("table"))
    return words.join(tables.select("table").distinct(), "table").select("table", F.trim("section").alias("section"))


def propose_explores(prints: DataFrame) -> DataFrame:
    """table, joins, always_filter: each primary table with the joins of its queries, once each, by their position; and "last 90 days" on
    its first date column by name."""
    rows = prints.where("parse_error is null and primary_table is not null").withColumnRenamed("primary_table", "table")
    joins = rows.select("table", "ctes", F.explode("joins").alias("j")).where(~F.array_contains("ctes", F.col("j.table")))
    joins = joins.groupBy("table", F.col("j.table").alias("right_table"), F.col("j.left_key").alias("left_key"), F.col("j.right_key").alias("right_key"), F.col("j.kind").alias("kind")).agg(F.min("j.position").alias("position"))
    listed = joins.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("position", "right_table", "left_key", "right_key", "kind"))).alias("joins"))
    dates = rows.select("table", F.explode("date_parts").alias("d")).groupBy("table").agg(F.min("d.column").alias("date"))
    out = rows.select("table").distinct().join(listed, "table", "left").join(dates, "table", "left")
    return out.select("table", F.coalesce("joins", F.array().cast(listed.schema["joins"].dataType)).alias("joins"), F.when(F.col("date").isNotNull(), F.concat("date", F.lit(": last 90 days"))).alias("always_filter"))


def baseline_gaps(fields: DataFrame) -> DataFrame:
    """view, kind, name, gap: what an author has to add to a baseline.

    Dimensions lack descriptions (or have ones under 30 characters), labels and tags; measures a value format (column value_format, if
    any); a view lacks a primary key where it has dimensions, and has plain dimensions of dates to promote.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    short = ~blank("description") & (F.length(F.trim("description")) < 30)
    faults = F.array_compact(F.array(F.when(blank("description"), "missing_description").when(short, "short_description"), F.when(blank("label"), "missing_label"), F.when(F.coalesce(F.size("tags"), F.lit(0)) <= 0, "missing_tags")))
    out = fields.where("kind = 'dimension'").select("view", F.lit("dim").alias("kind"), "name", F.explode(faults).alias("gap"))
    unformatted = fields.where("kind = 'measure'") if "value_format" not in fields.columns else fields.where((F.col("kind") == "measure") & blank("value_format"))
    out = out.unionByName(unformatted.select("view", F.lit("measure").alias("kind"), "name", F.lit("missing_value_format").alias("gap")))
    signs = _signs(fields)
    views = F.array_compact(F.array(F.when(F.col("plain_dates") > 0, "promote_to_dim_group"), F.when((F.col("dims") > 0) & (F.col("keys") == 0), "missing_primary_key")))
    return out.unionByName(signs.select("view", F.lit("view").alias("kind"), F.col("view").alias("name"), F.explode(views).alias("gap")))


def _signs(fields: DataFrame) -> DataFrame:
    """view, dims, keys, plain_dates (dimensions that are dates by type or name)."""
    date = (F.col("kind") == "dimension") & (F.lower("type").isin("date", "date_time", "timestamp", "datetime") | F.lower("name").rlike(r"(_dt|_date|_ts|_timestamp)$"))
    return fields.groupBy("view").agg(F.count_if(F.col("kind") == "dimension").alias("dims"), F.count_if(F.array_contains("tags", "primary_key")).alias("keys"), F.count_if(date).alias("plain_dates"))


def risks(context: DataFrame, structural: DataFrame, fields: DataFrame) -> DataFrame:
    """table, kind (risk or question), topic, n: what a reviewer has to look at, by rules.

    ``context`` is that of ``corpus.table_context``, ``structural`` the rows of ``corpus.structural_filters``.
    """
    filters = structural.groupBy("table").agg(F.count("*").alias("filters"))
    rows = context.join(_signs(fields).withColumnRenamed("view", "table"), "table", "left").join(filters, "table", "left")
    keyless = F.col("keys") == 0
    item = lambda kind, topic, n, when: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(topic).alias("topic"), n.cast("bigint").alias("n")))
    n_ctes, n_temp = F.size("ctes"), F.size("temp_tables")
    items = F.array_compact(
        F.array(
            item("risk", "no primary key", F.lit(1), keyless),
            item("risk", "derived views need structural filters", n_ctes, n_ctes > 0),
            item("risk", "temporary tables may become persistent", n_temp, n_temp > 0),
            item("risk", "structural filters must be baked in", F.col("filters"), F.col("filters") > 0),
            item("risk", "dates are plain dimensions", F.col("plain_dates"), F.col("plain_dates") > 0),
            item("question", "persistent or plain derived tables", n_temp, n_temp > 0),
            item("question", "relationship of each join", F.col("n_joins"), F.col("n_joins") > 0),
            item("question", "which column is the primary key", F.lit(1), keyless),
        )
    )
    return rows.select("table", F.explode(items).alias("x")).select("table", "x.*")


def needed_and_existing(context: DataFrame, prints: DataFrame, fields: DataFrame, share: float = 0.8) -> DataFrame:
    """One row for each table: counts of its existing fields, and what its queries need.

    needed_measures as FUNCTION(column), needed_dim_groups (date columns), needed_derived (CTEs), common_filters: columns that at least
    ``share`` of its queries filter by in their outermost query.
    """
    g = prints.where("parse_error is null")
    uses = g.select("query_id", F.explode("tables").alias("table"), "main_filters")
    often = uses.select("table", F.explode(F.array_distinct("main_filters")).alias("column")).groupBy("table", "column").agg(F.count("*").alias("k"))
    often = often.join(context.select("table", "queries"), "table").where(F.col("k") >= share * F.col("queries")).groupBy("table").agg(F.array_sort(F.collect_list("column")).alias("common_filters"))
    existing = fields.groupBy(F.col("view").alias("table")).agg(F.count_if(F.col("kind") == "dimension").alias("dimensions"), F.count_if(F.col("kind") == "measure").alias("measures"), F.count_if(F.col("kind") == "dimension_group").alias("dim_groups"), (F.count_if(F.array_contains("tags", "primary_key")) > 0).alias("has_key"))
    written = F.array_sort(F.array_distinct(F.transform("aggregations", lambda a: F.concat(a["function"], F.lit("("), F.coalesce(a["column"], F.lit("*")), F.lit(")")))))
    rows = context.select("table", written.alias("needed_measures"), F.array_sort(F.array_distinct(F.transform("date_parts", lambda d: d["column"]))).alias("needed_dim_groups"), F.col("ctes").alias("needed_derived"))
    out = rows.join(often, "table", "left").join(existing, "table", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("table", zero("dimensions"), zero("measures"), zero("dim_groups"), F.coalesce("has_key", F.lit(False)).alias("has_key"), "needed_measures", "needed_dim_groups", "needed_derived", F.coalesce("common_filters", F.array().cast("array<string>")).alias("common_filters"))


def filter_catalog(viewed: DataFrame) -> DataFrame:
    """table, column, operator, n: the filters that queries put on each table, flattened and tagged with it."""
    rows = viewed.select(F.col("view").alias("table"), F.explode("predicates").alias("p")).where("p.scope = 0")
    return rows.groupBy("table", F.col("p.column").alias("column"), F.col("p.operator").alias("operator")).agg(F.count("*").alias("n"))


def golden_questions(viewed: DataFrame) -> DataFrame:
    """table, query_id, question: prompts of the queries of each view."""
    return viewed.where("trim(prompt) <> ''").select(F.col("view").alias("table"), "query_id", F.trim("prompt").alias("question"))


def origins(fields: DataFrame, existing: DataFrame, used: DataFrame, described: DataFrame) -> DataFrame:
    """view, origin, n: where fields come from: a query (used: view, name), metadata (described: view, name), the baseline, or a guess.

    Fields and marks are told apart by flags and aggregated together by view and name; nothing is joined, so no side has to be small.
    """
    flags = ("field", "old", "asked", "known")
    mark = lambda rows, flag: rows.select("view", "name", *[(F.lit(True) if f == flag else F.lit(None).cast("boolean")).alias(f) for f in flags])
    rows = mark(fields, "field")
    for more, flag in ((existing, "old"), (used, "asked"), (described, "known")):
        rows = rows.unionByName(mark(more, flag).where("view is not null and name is not null"))  # no field is known by a null
    told = rows.groupBy("view", "name").agg(F.count("field").alias("n"), *[F.bool_or(f).alias(f) for f in flags[1:]]).where("n > 0")
    origin = F.when(F.col("old"), "existing_preserved").when(F.col("asked"), "gold_query").when(F.col("known"), "mdm").otherwise("inferred")
    return told.groupBy("view", origin.alias("origin")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
