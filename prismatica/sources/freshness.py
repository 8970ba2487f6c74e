"""Metadata answers as of a moment: which cached answer still holds, what a fetch brought instead, and the label where there is neither.

Fetching itself isn't done here: what a service answered is a table (table, code, text), as the cache is a folder of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatica.functions.naming import label

ANSWER = "map<string,string>"
#: Keys under which older answers keep the same thing, best first.
COLUMNS, NAMES, DEFINITIONS, SYNONYMS = ("columns", "attributes", "fields"), ("canonical_name", "display_name"), ("definition", "description"), ("synonyms", "aliases")


def cached_answers(spark: SparkSession, folder: str) -> DataFrame:
    """table, modified, text: one row for each <table>.json in a folder or below it, with the time at which the file was written."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    named = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return files.select(named.alias("table"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def _is_object(text: Column) -> Column:
    """Whether a text is one JSON object."""
    return F.coalesce(F.is_valid_utf8(text) & F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*\{"), F.lit(False))


def answers(wanted: DataFrame, cached: DataFrame, fetched: DataFrame, as_of: Column, ttl_hours: float = 24) -> DataFrame:
    """table, source, status, missed, reason, text: one row for each wanted table.

    cache: the youngest readable cached answer (table, modified, text) written at most ``ttl_hours`` before ``as_of`` and not after it;
    of equally young ones the greatest text.  Otherwise ``missed`` says why (absent, stale, unreadable: the last of these that holds),
    and a fetched row (table, code, text) decides.  api: a readable object with a code from 200 to 299.  fallback: nothing fetched, no
    code (the network failed), or 404; its text is null and its status success.  error: any other code, or an answer that isn't an
    object.  Of several fetched rows of a table the one with the lowest code counts, then the least text.  Null tables are left out.
    """
    age = (as_of.cast("double") - F.col("modified").cast("double")) / 3600
    past = cached.where(F.col("table").isNotNull()).select("table", "modified", "text", age.alias("age"), _is_object(F.col("text")).alias("readable")).where("age >= 0")
    fresh = F.col("age") <= ttl_hours
    held = past.groupBy("table").agg(
        F.max(F.when(fresh & F.col("readable"), F.struct("modified", "text"))).alias("best"),
        F.bool_or(fresh).alias("any_fresh"),
    )
    came = fetched.where(F.col("table").isNotNull()).groupBy("table").agg(F.min(F.struct(F.col("code").isNull().alias("failed"), "code", "text")).alias("came"))
    rows = wanted.where(F.col("table").isNotNull()).select("table").distinct().join(held, "table", "left").join(came, "table", "left")
    hit, code, text = F.col("best").isNotNull(), F.col("came.code"), F.col("came.text")
    missed = F.when(~hit, F.when(F.col("any_fresh"), "unreadable").when(F.col("any_fresh").isNotNull(), "stale").otherwise("absent"))
    refused = ~code.between(200, 299)
    source = F.when(hit, "cache").when(code.isNull() | (code == 404), "fallback").otherwise("api")
    reason = (
        F.when(hit, F.lit(None).cast("string"))
        .when(F.col("came").isNull(), "not fetched")
        .when(code.isNull(), F.coalesce(text, F.lit("no answer")))
        .when(code == 404, "404")
        .when(refused, F.concat(F.lit("HTTP "), code.cast("string"), F.lit(": "), F.left(F.coalesce(text, F.lit("")), F.lit(200))))
        .when(~_is_object(text), "not a JSON object")
    )
    rows = rows.select("table", source.alias("source"), missed.alias("missed"), reason.alias("reason"), F.when(hit, F.col("best.text")).otherwise(text).alias("text"))
    failed = (F.col("source") == "api") & F.col("reason").isNotNull()
    return rows.select("table", "source", F.when(failed, "error").otherwise("success").alias("status"), "missed", "reason", F.when(~failed & (F.col("source") != "fallback"), F.col("text")).alias("text"))


def misses(answered: DataFrame) -> DataFrame:
    """table, missed, source, status: what the cache didn't have, to be written beside it."""
    return answered.where(F.col("missed").isNotNull()).select("table", "missed", "source", "status")


def _said(answer: Column, keys: tuple[str, ...]) -> Column:
    """The first value under one of the keys that says something: not null, an empty text, list or object, zero or false."""
    value = lambda k: F.try_element_at(answer, F.lit(k))
    return F.coalesce(*[F.when(~value(k).rlike(r"^(?:\s*|\[\s*\]|\{\s*\}|0|false)$"), value(k)) for k in keys])


def _answer() -> Column:
    return F.coalesce(F.from_json("text", ANSWER), F.create_map().cast(ANSWER))


def digests(answered: DataFrame) -> DataFrame:
    """table, source, canonical_name, definition, synonyms, entity_type, n_columns, coverage: answers of any age in one shape.

    A name that isn't given is the table's, or its label where nothing was found; errors have no digest.  coverage is the share of
    columns with a definition or description, three digits, 0 without columns.
    """
    a = _answer()
    rows = answered.where("status = 'success'").select("table", "source", a.alias("a"), "text")
    name = F.coalesce(_said(F.col("a"), NAMES), F.when(F.col("source") == "fallback", label(F.col("table"))).otherwise(F.col("table")))
    synonyms = F.coalesce(F.from_json(_said(F.col("a"), SYNONYMS), "array<string>"), F.array().cast("array<string>"))
    rows = rows.select("table", "source", name.alias("canonical_name"), F.coalesce(_said(F.col("a"), DEFINITIONS), F.lit("")).alias("definition"), synonyms.alias("synonyms"), F.try_element_at("a", F.lit("entity_type")).alias("entity_type"), _columns(F.col("a")).alias("c"))
    described = F.size(F.filter(F.map_values("c"), lambda v: F.coalesce(F.trim(_said(v, DEFINITIONS)), F.lit("")) != ""))
    n = F.size("c")
    return rows.select("table", "source", "canonical_name", "definition", "synonyms", "entity_type", n.cast("bigint").alias("n_columns"), F.round(described / F.greatest(n, F.lit(1)), 3).alias("coverage"))


def _columns(answer: Column) -> Column:
    """Columns by name: of a map its keys, of a list its named objects (of equal names the last one)."""
    said = _said(answer, COLUMNS)
    listed = F.filter(F.coalesce(F.from_json(F.when(said.rlike(r"^\s*\["), said), f"array<{ANSWER}>"), F.array().cast(f"array<{ANSWER}>")), lambda c: F.coalesce(F.try_element_at(c, F.lit("name")), F.lit("")) != "")
    name = lambda c: F.try_element_at(c, F.lit("name"))
    last = F.filter(listed, lambda c, i: ~F.exists(F.slice(listed, i + 2, F.size(listed)), lambda d: name(d) == name(c)))
    keyed = F.from_json(F.when(said.rlike(r"^\s*\{"), said), ANSWER)
    inner = F.transform_values(keyed, lambda _, v: F.coalesce(F.from_json(v, ANSWER), F.create_map().cast(ANSWER)))
    return F.coalesce(inner, F.map_from_arrays(F.transform(last, name), last))


def columns(answered: DataFrame) -> DataFrame:
    """table, name, description, attributes: one row for each column that an answer names; attributes hold all it says of it."""
    rows = answered.where("status = 'success'").select("table", F.explode(_columns(_answer())).alias("name", "attributes"))
    return rows.select("table", "name", F.trim(_said(F.col("attributes"), DEFINITIONS)).alias("description"), "attributes")
