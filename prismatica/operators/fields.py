"""Operators over semantic-model fields as rows: merge, catalogs, coverage, gates, quality signals.

A field is a row (view, kind, name, type, sql, label, description, tags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismatica.operators.lineage import cut

#: A baseline description of at least so many characters is kept.
KEEP_DESCRIPTION = 30
KEY = ["view", "kind", "name"]


def field_kind(kind: Column) -> Column:
    """Kind of a field by its type."""
    measures = ("sum", "count", "count_distinct", "average", "min", "max", "sum_distinct", "average_distinct", "number", "median")
    return F.when(kind == "time", "dimension_group").when(kind.isin(*measures), "measure").otherwise("dimension")


def _joined(baseline: DataFrame, enriched: DataFrame) -> DataFrame:
    sides = []
    for side, rows in (("b", baseline), ("e", enriched)):
        sides.append(rows.select(*KEY, F.struct("type", "sql", "label", "description", "tags").alias(side)))
    # Both sides grow alike, and rows made from few columns look small: the hint keeps one side from being sent whole through the driver.
    return sides[0].join(sides[1].hint("merge"), KEY, "full")


def merge_fields(baseline: DataFrame, enriched: DataFrame) -> DataFrame:
    """Additive merge: SQL and type stay, labels fill in, long descriptions stay, short ones are replaced, tags are united in order."""
    short = F.length(F.coalesce("b.description", F.lit(""))) < KEEP_DESCRIPTION
    both = F.col("b").isNotNull() & F.col("e").isNotNull()
    return _joined(baseline, enriched).select(
        *KEY,
        F.when(F.col("b").isNotNull(), F.col("b.type")).otherwise(F.col("e.type")).alias("type"),
        F.when(F.col("b").isNotNull(), F.col("b.sql")).otherwise(F.col("e.sql")).alias("sql"),
        F.coalesce(F.when(F.col("b.label") != "", F.col("b.label")), F.col("e.label"), F.col("b.label")).alias("label"),
        F.when(both & short, F.coalesce(F.when(F.col("e.description") != "", F.col("e.description")), F.col("b.description"))).otherwise(F.coalesce("b.description", "e.description")).alias("description"),
        F.array_distinct(F.concat(F.coalesce("b.tags", F.array().cast("array<string>")), F.coalesce("e.tags", F.array().cast("array<string>")))).alias("tags"),
    )


def overwrites(baseline: DataFrame, enriched: DataFrame) -> DataFrame:
    """Descriptions that the merge replaces: view, kind, name, was, now."""
    was, now = F.col("b.description"), F.col("e.description")
    changed = (F.coalesce(was, F.lit("")) != "") & (F.length(was) < KEEP_DESCRIPTION) & (F.coalesce(now, F.lit("")) != "") & (now != was)
    return _joined(baseline, enriched).where(changed).select(*KEY, was.alias("was"), now.alias("now"))


def metric_catalog(fields: DataFrame) -> DataFrame:
    """Measures by view.measure; of repeated ones the first by label and SQL counts."""
    first = Window.partitionBy("view", "name").orderBy("label", "sql")
    rows = fields.where("kind = 'measure'").withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select(F.concat_ws(".", "view", "name").alias("metric"), "type", "sql", "label")


#: Measure types that answer an aggregate function; number answers any but count_distinct.
ANSWERS = {"SUM": ("sum", "sum_distinct"), "COUNT": ("count", "count_distinct"), "AVG": ("average", "average_distinct"), "MIN": ("min",), "MAX": ("max",), "STDDEV": ("number",), "VARIANCE": ("number",)}


def coverage(needs: DataFrame, fields: DataFrame) -> DataFrame:
    """Needs with the flag ``covered``.

    A need is (query_id, need, function, column): need is "measure" or "dimension".  A measure answers if its type is right and its
    SQL names the column (any measure of the type where the column is null); a dimension if its name or SQL is the column.
    """
    answers = F.create_map(*[x for f, kinds in ANSWERS.items() for x in (F.lit(f), F.array(*map(F.lit, kinds)))])
    # Fields name few columns each, so both sides meet by equality on single words, never by containment in each pair.
    words = F.array_distinct(F.concat(F.array(F.lower("name")), F.regexp_extract_all(F.lower("sql"), F.lit(r"(\w+)"), F.lit(1))))
    by_word = fields.select(F.when(F.col("kind") == "measure", "measure").otherwise("dimension").alias("need"), F.col("type"), F.explode(words).alias("column")).distinct()
    wanted = needs.withColumn("column", F.lower("column"))
    dims = wanted.where("need = 'dimension'").join(by_word.where("need = 'dimension'").select("column").distinct().withColumn("hit", F.lit(True)), "column", "left")
    typed = wanted.where("need = 'measure'").withColumn("type", F.explode(answers[F.col("function")]))
    of_type = fields.where("kind = 'measure'").select("type").distinct().withColumn("any", F.lit(True))
    of_word = by_word.where("need = 'measure'").select("type", "column").withColumn("hit", F.lit(True))
    found = typed.join(of_type, "type", "left").join(of_word, ["type", "column"], "left")
    measures = found.groupBy("query_id", "need", "function", "column").agg(F.max(F.coalesce(F.when(F.col("column").isNull(), F.col("any")).otherwise(F.col("hit")), F.lit(False))).alias("covered"))
    return dims.select("query_id", "need", "function", "column", F.coalesce("hit", F.lit(False)).alias("covered")).unionByName(measures)


def coverage_by_query(checked: DataFrame) -> DataFrame:
    return checked.groupBy("query_id").agg(F.bool_and("covered").alias("covered"), F.count_if(~F.col("covered")).alias("missing"))


def coverage_share(by_query: DataFrame) -> DataFrame:
    """Share of covered queries in percent; 100 for no queries."""
    return by_query.agg(F.coalesce(F.round(100 * F.count_if("covered") / F.nullif(F.count("*"), F.lit(0)), 2), F.lit(100.0)).alias("coverage_pct"))


def gaps(checked: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent unanswered needs, with the category of the remedy."""
    label = F.concat_ws(" ", "need", F.coalesce("function", F.lit("")), F.coalesce("column", F.lit("*")))
    rows = checked.where("not covered").groupBy(label.alias("gap"), F.lit("prompt_fix").alias("category")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "gap").limit(top)


def regressions(before: DataFrame, now: DataFrame) -> DataFrame:
    """Queries covered before and not now."""
    return before.where("covered").select("query_id").join(now.where("covered").select("query_id"), "query_id", "left_anti")


def status(blocking: Column, warnings: Column) -> Column:
    return F.when(F.size(blocking) > 0, "fail").when(F.size(warnings) > 0, "warn").otherwise("pass")


def enrichment_gate(fields: DataFrame) -> DataFrame:
    """view, status, blocking, warnings: a primary key and a description for each field, of 15 to 200 characters."""
    n = F.length(F.coalesce("description", F.lit("")))
    view = fields.groupBy("view").agg(F.count_if(F.array_contains("tags", "primary_key")).alias("keys"), F.count_if(n == 0).alias("bare"), F.count_if((n > 0) & ~n.between(15, 200)).alias("odd"), F.count_if(F.col("kind") == "measure").alias("measures"))
    blocking = F.array_compact(F.array(F.when(F.col("keys") == 0, "no primary key"), F.when(F.col("bare") > 0, "fields without description")))
    warnings = F.array_compact(F.array(F.when(F.col("odd") > 0, "descriptions of unusual length"), F.when(F.col("measures") == 0, "no measures")))
    return view.select("view", status(blocking, warnings).alias("status"), F.array_join(blocking, "; ").alias("blocking"), F.array_join(warnings, "; ").alias("warnings"))


def staging_gate(ranked: DataFrame) -> DataFrame:
    """Faults of a ranking (table, place, blocked_by): repeated places, unknown tables, tables that block themselves in the end."""
    repeated = ranked.groupBy("place").agg(F.count("*").alias("n"), F.min("table").alias("table")).where("n > 1").select("table", F.lit("repeated place").alias("fault"))
    edges = ranked.select("table", F.explode("blocked_by").alias("needs"))
    unknown = edges.join(ranked.select(F.col("table").alias("needs")), "needs", "left_anti").select("table", F.lit("unknown table").alias("fault"))
    return repeated.unionByName(unknown).unionByName(cycles(edges).select("table", F.lit("cycle").alias("fault"))).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """Tables on a cycle of edges(table, needs), or between two cycles.

    Edges whose table nobody needs, or that need a table without needs, are peeled off until none is left; each round is two semi joins
    over the edges, so paths are never enumerated.
    """
    left, size = edges.select("table", "needs").distinct(), -1
    while (now := left.count()) != size:
        size = now
        left = left.join(left.select(F.col("needs").alias("table")).distinct(), "table", "left_semi").join(left.select(F.col("table").alias("needs")).distinct(), "needs", "left_semi")
        left = cut(left)
    return left.select("table").distinct()


def approval_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("approver", "approved").agg(F.count("*").alias("n"))


def vocabulary_conflicts(fields: DataFrame) -> DataFrame:
    """SQL columns with more than one label, or more than one description."""
    rows = fields.where("kind = 'dimension'").groupBy("sql").agg(F.countDistinct("label").alias("labels"), F.countDistinct("description").alias("descriptions"))
    return rows.where("labels > 1 or descriptions > 1")


def baseline_quality(fields: DataFrame) -> DataFrame:
    """Counters of what a view's fields lack."""
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return fields.groupBy("view").agg(
        F.count("*").alias("n_fields"),
        F.count_if(missing("description")).alias("no_description"),
        F.count_if(~missing("description") & (F.length("description") < KEEP_DESCRIPTION)).alias("short_description"),
        F.count_if(missing("label")).alias("no_label"),
        F.count_if(F.size("tags") == 0).alias("no_tags"),
        F.count_if(F.col("kind") == "measure").alias("n_measures"),
        F.count_if(F.col("kind") == "dimension_group").alias("n_dates"),
    )


def view_complexity(derived: Column, joins: Column, has_case: Column) -> Column:
    score = derived * 2 + joins + F.when(has_case, 1).otherwise(0)
    return F.when(score == 0, "simple").when(score <= 3, "medium").otherwise("complex")


def changed_share(before: Column, after: Column) -> Column:
    """Lines that only one of two texts has, as a share of the lines of the first."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    return (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))) / F.greatest(F.size(F.array_distinct(a)), F.lit(1))
