"""Whether a semantic model answers a query corpus: needs of the queries as rows, checked against rows of the model.

A model is ``fields`` (view, kind, name, type, sql), ``views`` (view, table, derived: SQL of a derived table or null) and ``explores``
(explore, base, always_where, joins: array of (view, sql_on, relationship)).  Texts are compared by the words and literals they hold, so
every check is an equality join, never a containment test of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatica.operators import fields as M
from prismatica.operators.corpus import good

#: Needs that a better model answers; the others need better metadata.
MODEL_NEEDS = ("measure", "dimension", "derived", "structural")
#: What a derived table's name may add to the name of its CTE or temporary table.
DERIVED_SUFFIXES = ("", "_dt", "_pdt")
NEED = ("query_id", "need", "function", "column", "parts")


def _words(text: Column) -> Column:
    """Lower-case words of a text, and its quoted literals."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"(\w+)"), F.lit(1)), F.regexp_extract_all(low, F.lit(r"'([^']*)'"), F.lit(1))))


def needs(prints: DataFrame) -> DataFrame:
    """query_id, need, function, column, parts: what each query asks of a model, once each.

    Tables; joined tables (parts: the primary table); measures; dimensions (selected, grouped or filtered by in the outermost query);
    CASE expressions (parts: their results); CTEs and created tables (parts: columns they filter by); their filters (parts: column and
    value).  All in lower case but functions.
    """
    plain = lambda text: F.lower(F.regexp_replace(text, r"^'(.*)'$", "$1"))

    def rows(need: str, values: Column, column, parts=None, function=None) -> Column:
        """The needs of one kind, from an array of facets."""
        return F.transform(
            values,
            lambda x: F.struct(
                F.lit(need).alias("need"),
                (function(x) if function else F.lit(None).cast("string")).alias("function"),
                F.lower(column(x)).alias("column"),
                (parts(x) if parts else F.array().cast("array<string>")).alias("parts"),
            ),
        )

    local = F.concat("ctes", "temp_tables")
    asked = F.array_distinct(F.concat("dimensions", "main_filters"))
    structural = F.flatten(F.transform("cte_parts", lambda c: c["filters"]))
    every = F.concat(
        rows("table", F.col("tables"), lambda x: x),
        rows("join", F.filter("joins", lambda j: ~F.array_contains(local, j["table"])), lambda x: x["table"], lambda x: F.array(F.lower("primary_table"))),
        rows("measure", F.col("aggregations"), lambda x: x["column"], function=lambda x: x["function"]),
        rows("dimension", asked, lambda x: x),
        rows("case", F.col("cases"), lambda x: F.coalesce(x["alias"], F.lit("")), lambda x: F.array_distinct(F.transform(x["branches"], lambda b: F.lower(b["then"])))),
        rows("derived", F.col("cte_parts"), lambda x: x["alias"], lambda x: F.array_distinct(F.transform(x["filters"], lambda f: F.lower(f["column"])))),
        rows("derived", F.col("created"), lambda x: x["alias"]),
        rows("structural", structural, lambda x: x["column"], lambda x: F.array(F.lower(x["column"]), plain(x["value"]))),
    )
    return good(prints).select("query_id", F.explode(F.array_distinct(every)).alias("n")).select("query_id", "n.*")


def _offers(fields: DataFrame, views: DataFrame, explores: DataFrame) -> DataFrame:
    """kind, key, source: what a model has, as keys that needs ask for."""
    low = lambda c: F.lower(F.col(c))
    offer = lambda df, kind, key, source=None: df.select(F.lit(kind).alias("kind"), key.alias("key"), (F.lit("") if source is None else source).alias("source"))
    tables = views.select("view", F.lower(F.coalesce("table", "view")).alias("name"))
    bases = explores.join(tables.select(F.col("view").alias("base"), F.col("name").alias("base_table")), "base").select("base_table", F.explode("joins").alias("j")).select("base_table", F.col("j.view").alias("view"))
    joined = bases.join(tables, "view")
    words = fields.select("*", F.explode(F.array_distinct(F.concat(F.array(low("name")), _words(F.col("sql"))))).alias("word"))
    dims = fields.where("kind = 'dimension'")
    derived = views.where("derived is not null").select(F.lower("view").alias("view"), F.explode(_words(F.col("derived"))).alias("word"))
    out = offer(views.where("table is not null"), "table", low("table"))
    for more in (
        offer(joined, "join", F.concat_ws("|", "base_table", "name")),
        offer(words.where("kind <> 'measure'"), "dimension", F.col("word")),
        offer(words.where("kind = 'measure'"), "measure", F.concat_ws("|", "type", "word")),
        offer(fields.where("kind = 'measure'"), "measure", F.concat_ws("|", "type", F.lit("*"))),
        offer(dims, "case", low("name")),
        offer(dims.where("lower(sql) like '%case%when%'").select("view", "name", F.explode(_words(F.col("sql"))).alias("word")), "case_word", F.col("word"), F.concat_ws(".", "view", "name")),
        offer(derived, "derived", F.col("view")),
        offer(derived, "derived_word", F.concat_ws("|", "view", "word")),
        offer(derived, "any_word", F.col("word"), F.col("view")),
        offer(explores.where("always_where is not null").select(F.explode(_words(F.col("always_where"))).alias("word")), "always", F.col("word")),
    ):
        out = out.unionByName(more)
    return out.distinct()


def _asked() -> Column:
    """Ways to answer a need, as keys: array of (way, kind, key, n), where all n keys of a way must come from one source."""

    def one(way: int, kind: str, key: Column) -> Column:
        return F.array(F.struct(F.lit(way).alias("way"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(1).alias("n")))

    def all_parts(way: int, kind: str, key) -> Column:
        return F.transform("parts", lambda p: F.struct(F.lit(way).alias("way"), F.lit(kind).alias("kind"), key(p).alias("key"), F.size("parts").alias("n")))

    types = F.create_map(*[x for f, kinds in M.ANSWERS.items() for x in (F.lit(f), F.array(*map(F.lit, kinds)))])
    measures = F.transform(types[F.col("function")], lambda t, i: F.struct(i.alias("way"), F.lit("measure").alias("kind"), F.concat_ws("|", t, F.coalesce("column", F.lit("*"))).alias("key"), F.lit(1).alias("n")))
    derived = []
    for way, suffix in enumerate(DERIVED_SUFFIXES):
        name = F.concat("column", F.lit(suffix))
        derived.append(F.when(F.size("parts") == 0, one(way, "derived", name)).otherwise(all_parts(way, "derived_word", lambda p, name=name: F.concat_ws("|", name, p))))
    need = F.col("need")
    return (
        F.when(need == "table", one(0, "table", F.col("column")))
        .when(need == "join", one(0, "join", F.concat_ws("|", F.get("parts", F.lit(0)), "column")))
        .when(need == "measure", measures)
        .when(need == "dimension", one(0, "dimension", F.col("column")))
        .when(need == "case", F.concat(one(0, "case", F.col("column")), all_parts(1, "case_word", lambda p: p)))
        .when(need == "derived", F.concat(*derived))
        .when(need == "structural", F.concat(one(0, "always", F.col("column")), all_parts(1, "any_word", lambda p: p)))
    )


def check(wanted: DataFrame, fields: DataFrame, views: DataFrame, explores: DataFrame) -> DataFrame:
    """The needs with the flag ``covered``.

    A table needs a view; a join an explore over both tables; a CASE a dimension of its name, or one whose SQL has all its results; a
    CTE a derived table of its name whose SQL has the columns it filters by; a structural filter a derived table whose SQL has its
    column and value, or an explore's fixed condition with the column; measures and dimensions as in ``fields.coverage``.  One join on
    keys, and one aggregation.
    """
    # Needs without any way to answer them stay as keys that nothing meets, so they are read once.
    keys = wanted.select(*NEED, F.explode_outer(_asked()).alias("a")).select(*NEED, "a.*")
    met = keys.join(_offers(fields, views, explores), ["kind", "key"], "left").groupBy(*NEED, "way", "n", "source").agg(F.count("*").alias("k"))
    return met.groupBy(*NEED).agg(F.bool_or(F.col("source").isNotNull() & (F.col("k") == F.col("n"))).alias("covered"))


def category(need: Column) -> Column:
    """What would answer an open need: the model's author, or the metadata."""
    return F.when(need.isin(*MODEL_NEEDS), "prompt_fix").otherwise("mdm_fix")


def open_needs(checked: DataFrame, top: int = 10) -> DataFrame:
    """gap, category, n: the most frequent open needs."""
    label = F.concat_ws(" ", "need", F.coalesce("function", F.lit("")), F.coalesce("column", F.lit("*")))
    rows = checked.where("not covered").groupBy(label.alias("gap"), category(F.col("need")).alias("category")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "gap").limit(top)


def three_way(checked: DataFrame) -> DataFrame:
    """query_id, status: pass, partial (under half of the needs open) or fail."""
    counted = checked.groupBy("query_id").agg(F.count_if(~F.col("covered")).alias("open"), F.count("*").alias("n"))
    return counted.select("query_id", F.when(F.col("open") == 0, "pass").when(F.col("open") * 2 < F.col("n"), "partial").otherwise("fail").alias("status"))


def reconstruction(checked: DataFrame, prints: DataFrame, views: DataFrame, explores: DataFrame) -> DataFrame:
    """query_id, level, fault: why the SQL of a query couldn't be made from the model.

    Queries without an explore over their primary table warn.  A base or joined view without table or derived SQL, a join without
    condition or relationship, an aggregate without measure, and a structural filter that is nowhere, block.
    """
    solid = views.where("table is not null or derived is not null").select("view").distinct().withColumn("solid", F.lit(True))
    based = explores.join(views.select(F.col("view").alias("base"), F.lower(F.coalesce("table", "view")).alias("primary")), "base")
    used = good(prints).select("query_id", F.lower("primary_table").alias("primary"))
    lacking = used.join(based.select("primary").distinct(), "primary", "left_anti").select("query_id", F.lit("warn").alias("level"), F.lit("no explore").alias("fault"))
    faults = explores.join(solid.withColumnRenamed("view", "base"), "base", "left_anti").select("explore", F.concat(F.lit("no table for view "), F.col("base")).alias("fault"))
    joins = explores.select("explore", F.explode("joins").alias("j")).select("explore", "j.*")
    faults = faults.unionByName(joins.join(solid, "view", "left_anti").select("explore", F.concat(F.lit("no table for view "), F.col("view")).alias("fault")))
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    for column, what in (("sql_on", "no condition for join "), ("relationship", "no relationship for join ")):
        faults = faults.unionByName(joins.where(empty(column)).select("explore", F.concat(F.lit(what), F.col("view")).alias("fault")))
    blocked = used.join(based.select("primary", "explore"), "primary").join(faults, "explore").select("query_id", F.lit("block").alias("level"), "fault")
    missing = checked.where("not covered and need in ('measure', 'structural')").select("query_id", F.lit("block").alias("level"), F.concat_ws(" ", F.lit("no"), "need", "function", "column").alias("fault"))
    return lacking.unionByName(blocked).unionByName(missing.join(lacking.select("query_id"), "query_id", "left_anti")).distinct()
