"""Which texts contain which others, by an inverted index of short pieces; and coverage of a corpus by what a model's texts contain.

Every needle is looked up by its rarest piece of ``q`` characters, so only texts that hold that piece are compared with it; the
comparison itself is exact.  Needles and texts are never paired otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatica.operators import coverage
from prismatica.operators.corpus import good
from prismatica.operators.fields import ANSWERS
from prismatica.operators.lineage import cut

#: Characters of a piece.
PIECE = 3
#: Fixed value: so many first characters of a CASE stand for it.
CASE_PREFIX = 30
#: Facets that needs are made of.
READ = ("tables", "ctes", "temp_tables", "joins", "aggregations", "dimensions", "main_filters", "cases", "cte_parts", "created")


def _pieces(text: Column, size: int) -> Column:
    """Distinct pieces of a text, one from each place; none if it is shorter."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % size), F.lit(1)))


def contained(needles: DataFrame, texts: DataFrame, piece: int = PIECE) -> DataFrame:
    """group, needle, source: every needle (group, needle) that a text (group, source, text) of its group contains.

    Cases count as they are; nulls and empty needles are in nothing.  Needles shorter than a piece are pieces of their own.  The index
    holds only pieces that some needle has, with a text's id, never its text; which of a needle's pieces is the rarest is counted in
    the index itself.  A piece that very many texts hold is split by Spark.
    """
    asked = needles.select("group", "needle").where("needle <> ''").distinct()
    of_size = reduce(lambda c, k: F.when(F.length("needle") == k, _pieces(F.col("needle"), k)).otherwise(c), range(1, piece), _pieces(F.col("needle"), piece))
    pieces = asked.select("group", "needle", F.explode(of_size).alias("piece"))
    wanted = pieces.select("group", "piece").distinct()
    held = texts.where("text is not null").select("group", "source", F.explode(F.concat(*[_pieces(F.col("text"), k) for k in range(1, piece + 1)])).alias("piece"))
    index = held.join(wanted, ["group", "piece"], "left_semi")
    counts = index.groupBy("group", "piece").agg(F.count("*").alias("n"))
    # A piece that no text holds counts as 0, so its needle is in none.
    rarest = pieces.join(counts, ["group", "piece"], "left").groupBy("group", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r"))
    keys = rarest.where("r.n > 0").select("needle", F.struct("group", "r.piece").alias("key"))
    near = index.select("source", F.struct("group", "piece").alias("key")).join(keys, "key").select("key.group", "needle", "source")
    both = near.withColumn("key", F.struct("group", "source")).drop("group", "source").join(texts.where("text is not null").select("text", F.struct("group", "source").alias("key")), "key")
    return both.where(F.contains("text", "needle")).select("key.group", "needle", "key.source")


# ---------------------------------------------------------------------------------------------- coverage


def _flat(text: Column) -> Column:
    """Lower case, with one space in place of any white space."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _texts(fields: DataFrame, views: DataFrame, explores: DataFrame) -> DataFrame:
    """group, source, text: what a model says, by what it can answer."""
    sql = _flat(F.col("sql"))
    name = F.concat_ws(".", "view", "name")
    row = lambda df, group, source, text: df.select(group.alias("group"), source.alias("source"), text.alias("text"))
    # A field may be repeated, so its text is a part of its id.
    each = lambda c: F.concat_ws("|", name, c)
    dims, measures, derived = fields.where("kind <> 'measure'"), fields.where("kind = 'measure'"), views.where("derived is not null")
    by_sql = lambda c: F.concat_ws("|", "view", F.md5(_flat(c)))
    out = row(dims, F.lit("dimension"), each(sql), sql)
    for more in (
        row(measures, F.concat(F.lit("measure:"), "type"), each(sql), sql),
        row(measures, F.lit("any_measure"), each(F.concat_ws("|", "type", sql)), sql),
        row(dims.where("kind = 'dimension' and lower(sql) like '%case%' and lower(sql) like '%when%'"), F.lit("case"), each(sql), sql),
        row(derived, F.lit("derived_name"), by_sql(F.col("derived")), F.lower("view")),
        row(derived, F.lit("derived"), by_sql(F.col("derived")), _flat(F.col("derived"))),
        row(explores.where("always_where is not null"), F.lit("always"), F.concat_ws("|", "explore", F.md5("always_where")), _flat(F.col("always_where"))),
    ):
        out = out.unionByName(more)
    return out.distinct()


def _ways() -> Column:
    """Ways to answer a need: array of (way, group, needle, n), where one text must contain, or be, all n needles of a way."""

    def one(way: int, group, needle: Column, n=1) -> Column:
        return F.array(F.struct(F.lit(way).alias("way"), (F.lit(group) if isinstance(group, str) else group).alias("group"), needle.alias("needle"), (F.lit(n) if isinstance(n, int) else n).alias("n")))

    def parts(way: int, group: str, n) -> Column:
        return F.transform("parts", lambda p: F.struct(F.lit(way).alias("way"), F.lit(group).alias("group"), p.alias("needle"), n.alias("n")))

    need, column = F.col("need"), F.col("column")
    types = F.create_map(*[x for f, kinds in ANSWERS.items() for x in (F.lit(f), F.array(*map(F.lit, kinds)))])
    measures = F.transform(types[F.col("function")], lambda t, i: F.struct(i.alias("way"), F.concat(F.lit("measure:"), t).alias("group"), column.alias("needle"), F.lit(1).alias("n")))
    return (
        F.when(need == "measure", measures)
        .when(need == "dimension", one(0, "dimension", column))
        .when(need == "case", parts(0, "case", F.size("parts")))
        .when(need == "derived", F.concat(one(0, "derived_name", column, F.size("parts") + 1), parts(0, "derived", F.size("parts") + 1)))
        .when(need == "structural", F.concat(one(0, "always", column), parts(1, "derived", F.size(F.array_distinct("parts")))))
    )


def _more(prints: DataFrame) -> DataFrame:
    """Ways that the needs themselves don't say: the beginning of a CASE, and columns that are only selected, which a measure may hold."""
    none = F.array().cast("array<string>")
    case = good(prints).select("query_id", F.explode("cases").alias("x"))
    prefix = F.substring(_flat(F.col("x.sql")), 1, CASE_PREFIX)
    thens = F.array_distinct(F.transform("x.branches", lambda b: F.lower(b["then"])))
    cases = case.select("query_id", F.lit("case").alias("need"), F.lit(None).cast("string").alias("function"), F.lower(F.coalesce("x.alias", F.lit(""))).alias("column"), thens.alias("parts"), F.lit(2).alias("way"), F.lit("case").alias("group"), prefix.alias("needle"), F.lit(1).alias("n"))
    loose = good(prints).select("query_id", F.explode(F.array_except("dimensions", "main_filters")).alias("c"))
    loose = loose.select("query_id", F.lit("dimension").alias("need"), F.lit(None).cast("string").alias("function"), F.lower("c").alias("column"), none.alias("parts"), F.lit(3).alias("way"), F.lit("any_measure").alias("group"), F.lower("c").alias("needle"), F.lit(1).alias("n"))
    return cases.unionByName(loose)


def check(prints: DataFrame, fields: DataFrame, views: DataFrame, explores: DataFrame) -> DataFrame:
    """The needs of ``coverage.needs`` with the flag ``covered``, where texts are compared by what they contain.

    A column is covered by a dimension of its name, or one whose SQL contains it, and if it isn't filtered by also by a measure whose SQL
    does; an aggregate by a measure of the right type whose SQL contains its column; a CASE by a dimension of its name, or one whose CASE
    contains all its results, or its first 30 characters; a CTE by a derived table whose name contains its name and whose SQL contains
    the columns that it filters by; a structural filter by derived SQL that contains its column and value, or an explore's fixed
    condition that contains its column.  Of several derived tables any may answer.  Tables, joins and bare counts as in ``coverage``.
    """
    # Fingerprints are dear, and several branches read them.
    prints = cut(good(prints).select("query_id", "parse_error", "primary_table", *READ))
    wanted = coverage.needs(prints)
    need = list(coverage.NEED)
    keys = wanted.select(*need, F.explode(F.coalesce(_ways(), F.array().cast("array<struct<way:int,group:string,needle:string,n:int>>"))).alias("a")).select(*need, "a.*")
    keys = keys.unionByName(_more(prints)).where("needle <> ''").distinct()
    hits = contained(keys.select("group", "needle"), _texts(fields, views, explores))
    # Keys grow with the corpus, but are estimated too small to be left where they are.
    met = keys.hint("merge").join(hits, ["group", "needle"]).groupBy(*need, "way", "n", "source").agg(F.count("*").alias("k")).where("k = n").select(*need)
    same = coverage._offers(fields, views, explores).where("kind in ('table', 'join', 'case') or kind = 'measure' and key like '%|*'").select("kind", "key")
    same = same.unionByName(fields.where("kind <> 'measure'").select(F.lit("dimension").alias("kind"), F.lower("name").alias("key"))).distinct()
    equal = wanted.select(*need, F.explode(F.filter(coverage._asked(), lambda a: (a["n"] == 1) & a["kind"].isin("table", "join", "case", "measure", "dimension"))).alias("a")).select(*need, "a.kind", "a.key")
    met = met.unionByName(equal.join(same, ["kind", "key"], "left_semi").select(*need))
    both = wanted.withColumn("covered", F.lit(False)).unionByName(met.distinct().withColumn("covered", F.lit(True)))
    return both.groupBy(*need).agg(F.bool_or("covered").alias("covered"))
