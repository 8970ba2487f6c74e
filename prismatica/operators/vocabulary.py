"""Whether the fields of many views speak of the same things in the same words.

fields: DataFrame (view, kind, name, type, sql, label, description, tags).  Fields are of one concept when they have the same name, or
when all of a field's SQL is a column or field of that name, over any number of steps; dimensions and each type of measure apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatica.operators.lineage import cut

#: Names too common to say what a field is about; they never tie two fields together through SQL.
GENERIC = ("id", "name", "code", "key", "type", "status", "date", "value", "count", "n")
#: Words that contradict each other.
OPPOSITES = (("includes", "excludes"), ("including", "excluding"), ("with", "without"), ("gross", "net"), ("before", "after"), ("first", "last"), ("active", "inactive"), ("minimum", "maximum"), ("start", "end"))
WORD = r"([\p{L}\p{N}]+)"
FIELD = ["view", "kind", "name"]


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1)))


def _phrase(text: Column) -> Column:
    """A text's words in their order, lower-cased, one space between them."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1)), " ")


def _components(edges: DataFrame) -> DataFrame:
    """node, label (the least node that it is tied to) for edges(a, b): least labels of neighbours, then labels of labels, until none falls."""
    both = cut(edges.unionAll(edges.select("b", "a")).toDF("node", "other").distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        lower = cut(lower.join(hop, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = lower.select("node", "label")
        if lower.where("label <> was").isEmpty():
            return labels


def concepts(fields: DataFrame, generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """The fields with their concept, named by its least member: "dimension" or the measure's type, a colon, a name.

    Names compare lower-cased.  A null name or view is left out; a dimension group is a dimension.
    """
    sort = F.when(F.col("kind") == "measure", F.concat_ws(" ", F.lit("measure"), F.col("type"))).otherwise("dimension")
    rows = fields.where("view is not null and name is not null").withColumn("node", F.concat(sort, F.lit(":"), F.lower("name")))
    alone = lambda pattern: F.lower(F.regexp_extract(F.coalesce("sql", F.lit("")), pattern, 1))
    column, field = alone(r"^\s*\$\{TABLE\}\.`?(\w+)`?\s*$"), alone(r"^\s*\$\{(?:\w+\.)?(\w+)\}\s*$")
    named = F.when(column != "", column).otherwise(field)
    ties = rows.where((named != "") & ~named.isin(*generic) & ~F.lower("name").isin(*generic) & (named != F.lower("name")))
    found = _components(ties.select(F.col("node").alias("a"), F.concat(sort, F.lit(":"), named).alias("b")).distinct())
    return rows.join(found.select("node", F.col("label").alias("least")), "node", "left").withColumn("concept", F.coalesce("least", "node")).drop("node", "least")


def _usual(rows: DataFrame, column: str) -> DataFrame:
    """concept, usual: the text that most fields of a concept have, counted by its words; of several spellings the commonest, of equally common ones the greatest."""
    said = rows.where(F.col("phrase") != "").groupBy("concept", "phrase", column).agg(F.count("*").alias("n"))
    forms = said.groupBy("concept", "phrase").agg(F.sum("n").alias("n"), F.max(F.struct("n", column)).alias("form"))
    return forms.groupBy("concept").agg(F.max(F.struct("n", F.col(f"form.{column}").alias("form"))).alias("best")).select("concept", F.col("best.form").alias("usual"))


def _unlike(rows: DataFrame, column: str) -> DataFrame:
    told = rows.withColumn("phrase", _phrase(F.col(column)))
    return told.join(_usual(told, column), "concept").where(F.col("phrase") != "")


def _issue(kind: str, severity: Column, found: Column, expected: Column) -> list[Column]:
    return ["concept", *FIELD, F.lit(kind).alias("issue"), severity.alias("severity"), found.alias("found"), expected.alias("expected")]


def label_issues(shared: DataFrame) -> DataFrame:
    """Labels other than the concept's usual one: low if only case, spaces or signs differ, medium if a word is shared, else high."""
    alike = F.col("phrase") == _phrase(F.col("usual"))
    severity = F.when(alike, "low").when(F.arrays_overlap(_words(F.col("label")), _words(F.col("usual"))), "medium").otherwise("high")
    return _unlike(shared, "label").where(F.col("label") != F.col("usual")).select(*_issue("label", severity, F.col("label"), F.col("usual")))


def description_issues(shared: DataFrame) -> DataFrame:
    """Descriptions that contradict the usual one (high: a word against its opposite) or share no word of four letters or more with it (medium)."""
    said, usual = _words(F.col("description")), _words(F.col("usual"))
    against = lambda a, b: F.array_contains(said, a) & F.array_contains(usual, b) & ~F.array_contains(said, b) & ~F.array_contains(usual, a)
    opposite = F.lit(False)
    for a, b in OPPOSITES:
        opposite = opposite | against(a, b) | against(b, a)
    long = lambda words: F.filter(words, lambda w: F.length(w) >= 4)
    severity = F.when(opposite, "high").when(~F.arrays_overlap(long(said), long(usual)), "medium")
    return _unlike(shared, "description").withColumn("level", severity).where("level is not null").select(*_issue("description", F.col("level"), F.col("description"), F.col("usual")))


def tag_issues(shared: DataFrame) -> DataFrame:
    """Tags that other fields of the concept have: medium if more than half of its fields have it, else low."""
    tags = F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()))
    rows = shared.withColumn("own", tags)
    sizes = rows.groupBy("concept").agg(F.count("*").alias("fields"))
    held = rows.select("concept", F.explode("own").alias("tag")).groupBy("concept", "tag").agg(F.count("*").alias("n")).join(sizes, "concept")
    severity = F.when(F.col("n") * 2 > F.col("fields"), "medium").otherwise("low")
    return rows.join(held.where("n < fields"), "concept").where(~F.array_contains("own", F.col("tag"))).select(*_issue("tag", severity, F.lit(None).cast("string"), F.col("tag")))


def term_issues(fields: DataFrame, terms: DataFrame) -> DataFrame:
    """Words for which another is canonical, where both are in use: terms (term, canonical), as synonyms and names of metadata are.

    Labels and descriptions are read in runs of words, as many as the longest term has, and joined with the terms by equality.  A field
    that also says the canonical term isn't reported.
    """
    known = terms.select(_phrase(F.col("term")).alias("said"), _phrase(F.col("canonical")).alias("canonical")).where("said <> '' and canonical <> '' and said <> canonical").distinct()
    longest = known.select(F.max(F.greatest(F.size(F.split("said", " ")), F.size(F.split("canonical", " "))))).first()[0] or 1
    text = fields.select("concept", *FIELD, F.explode(F.array("label", "description")).alias("text"))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(1))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.filter(F.transform(words, lambda w, i: F.slice(words, i + 1, n)), lambda r: F.size(r) == n), lambda r: F.array_join(r, " "))))
    used = text.select("concept", *FIELD, F.explode(F.array_distinct(runs)).alias("said")).distinct()
    proper = used.join(known.select(F.col("canonical").alias("said")).distinct(), "said")
    alive = known.join(proper.select(F.col("said").alias("canonical")).distinct(), "canonical", "left_semi")
    wrong = used.join(alive, "said")
    return wrong.join(proper.select(*FIELD, F.col("said").alias("canonical")), [*FIELD, "canonical"], "left_anti").select(*_issue("term", F.lit("medium"), F.col("said"), F.col("canonical")))


def issues(fields: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """concept, view, kind, name, issue, severity, found, expected: what isn't said alike across views.

    Only concepts of two or more views are compared by label, description and tags; terms are looked for in all fields.  Fields with
    equal (view, kind, name) are compared each by itself, and equal issues are told once.  Null texts have nothing to compare.
    """
    found = cut(concepts(fields).select("concept", *FIELD, "label", "description", "tags"))
    several = found.groupBy("concept").agg(F.min("view").alias("a"), F.max("view").alias("b")).where("a <> b").select("concept")
    shared = found.join(several, "concept")
    said = label_issues(shared).unionByName(description_issues(shared)).unionByName(tag_issues(shared))
    return (said if terms is None else said.unionByName(term_issues(found, terms))).distinct()


def report(found: DataFrame) -> DataFrame:
    """consistent, high, medium, low: one row."""
    count = lambda level: F.count_if(F.col("severity") == level).alias(level)
    return found.agg((F.count("*") == 0).alias("consistent"), count("high"), count("medium"), count("low"))
