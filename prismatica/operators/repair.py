"""Whether a text is one readable query, and what makes it one.

Expressions on a text's own row, without a shuffle: the fold of ``sqltext.fault`` over its tokens, and for texts that fail the
candidates that each repair makes of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatica.functions.sqltext import COMMENT, PLAIN, TYPOGRAPHIC, fault
from prismatica.operators.statements import TOKEN

#: The repairs in the order in which they are tried.
STEPS = ("trim_trailing_semicolons", "normalize_smart_quotes", "first_statement", "strip_bq_scripting")
SCRIPTING = r"(?im)^\s*(?:DECLARE|SET|BEGIN|END|CALL)\s+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _first_statement(text: Column) -> Column:
    """The first of several statements that begins with SELECT, WITH or a bracket, as written; the text itself if there is none."""
    pieces = F.regexp_extract_all(text, F.lit(TOKEN + r"|\s+"), F.lit(0))
    cuts = F.filter(F.transform(pieces, lambda x, i: F.when(x == ";", i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(-1)), cuts, F.array(F.size(pieces)))
    parts = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda k: F.slice(pieces, F.get(edges, k) + 2, F.get(edges, k + 1) - F.get(edges, k) - 1))
    begins = lambda part: F.upper(F.get(F.filter(part, lambda x: ~x.rlike(COMMENT) & ~x.rlike(r"^\s")), F.lit(0)))
    asked = F.filter(parts, lambda part: begins(part).isin("SELECT", "WITH", "("))
    return F.when(F.size(cuts) > 0, F.coalesce(_trimmed(F.array_join(F.get(asked, F.lit(0)), "")), text)).otherwise(text)


def _without_scripting(text: Column) -> Column:
    """From the first SELECT or WITH on, where a line begins with a scripting word."""
    asked = F.regexp_extract(text, r"(?is)\b(?:SELECT|WITH)\b.*$", 0)
    return F.when(text.rlike(SCRIPTING) & (asked != ""), asked).otherwise(text)


def repaired(corpus: DataFrame) -> DataFrame:
    """query_id, prompt, fault, steps, repaired, remaining: each text, what is wrong with it, and the first candidate that is a query.

    Candidates follow ``STEPS``, each made of the one before; steps that change nothing are left out.  A text without fault keeps its
    words and has no steps; one that no candidate mends keeps all changes, and ``remaining`` says what is still wrong with it
    (``fault`` is about the text as it came).  A null or blank text is an empty_input, as is one of an empty literal alone.
    """
    blank = F.coalesce(F.trim(F.regexp_replace("sql", "^\\ufeff|[;\\s]+$", "")), F.lit("")).isin("", "''", '""', "``")
    rows = corpus.select("query_id", "prompt", F.coalesce(F.regexp_replace("sql", "^\\ufeff", ""), F.lit("")).alias("c0"), blank.alias("blank"))
    rows = rows.withColumn("fault", F.when(F.col("blank"), "empty_input").otherwise(fault(tokens(F.col("c0")))))
    for n, change in enumerate((lambda c: F.when(c.rlike(r";\s*$"), F.regexp_replace(c, r"^\s+|[;\s]+$", "")).otherwise(c), lambda c: F.translate(c, TYPOGRAPHIC, PLAIN), _first_statement, _without_scripting)):
        rows = rows.withColumn(f"c{n + 1}", F.when(F.col("fault").isNotNull() & ~F.col("blank"), change(F.col(f"c{n}"))))
    candidates = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(step).alias("step"), F.col(f"c{n}").alias("text")) for n, step in enumerate(STEPS, 1)])
    changed = F.filter(candidates, lambda c: c["text"] != F.element_at(F.array(*[f"c{n}" for n in range(len(STEPS))]), c["n"]))
    rows = rows.withColumn("tried", F.transform(changed, lambda c: F.struct(c["step"].alias("step"), c["text"].alias("text"), fault(tokens(c["text"])).alias("fault"))))
    mended = F.array_position(F.transform("tried", lambda c: c["fault"].isNull()), True).cast("int")
    rows = rows.withColumn("used", F.when(mended > 0, F.slice("tried", F.lit(1), mended)).otherwise(F.col("tried")))
    last = F.get("used", F.size("used") - 1)
    return rows.select("query_id", "prompt", "fault", F.transform("used", lambda c: c["step"]).alias("steps"), F.coalesce(last["text"], F.col("c0")).alias("repaired"), F.when(F.size("used") > 0, last["fault"]).otherwise(F.col("fault")).alias("remaining"))


def repair_counts(found: DataFrame) -> DataFrame:
    """fault, steps, remaining, queries: how often each way was taken; steps joined by " > "."""
    return found.groupBy("fault", F.array_join("steps", " > ").alias("steps"), "remaining").agg(F.count("*").alias("queries"))
