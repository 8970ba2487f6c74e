"""Cleaning of SQL texts and what can be told of them without their tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Aggregate functions that are recorded.
AGGREGATES = ("sum", "count", "avg", "min", "max", "stddev", "variance")
#: A literal (kept), or a comment; literals come first, so that what looks like a comment inside one stays.
QUOTED = r"""(?s)('(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|\\.)*")|--[^\n]*|/\*.*?\*/"""

#: Typographic quotes and the hard space, and what stands for them.
TYPOGRAPHIC, PLAIN = "‘’“”\u00a0", "''\"\" "
#: Words after which a clause can't begin and a bracket or text can't end.
HANGING = ("FROM", "JOIN", "ON", "WHERE", "AND", "OR", "BY", "HAVING", "QUALIFY", "LIMIT")
COMMENT = r"^(?:--|/\*)"


def bound(value: Column, use) -> Column:
    """use(value), the value being computed once however often it is read: the end of a fold over nothing, which copies neither."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda value, _: value, use)


def cleaned(sql: Column) -> Column:
    """Typographic quotes and hard spaces to ASCII, one surrounding code fence taken off, trimmed."""
    plain = F.translate(sql, TYPOGRAPHIC, PLAIN)
    fenced = F.regexp_extract(plain, r"(?is)^\s*```(?:sql)?\s*(.*?)\s*```\s*$", 1)
    return F.trim(F.when(fenced != "", fenced).otherwise(plain))


def normalised(sql: Column) -> Column:
    """Without byte order mark, comments, line breaks, and trailing semicolons."""
    bare = F.regexp_replace(F.regexp_replace(sql, "^\\ufeff", ""), QUOTED, "$1 ")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"[;\s]+$", "")


def _rank(up: Column, before: Column) -> Column:
    """The place of the clause that a word opens in its query; 0: the next query of a union; null: no clause."""
    return (
        F.when(up == "SELECT", 1)
        .when((up == "FROM") & (before != "DISTINCT"), 2)
        .when(up == "JOIN", 2)
        .when(up == "WHERE", 3)
        .when((up == "BY") & (before == "GROUP"), 4)
        .when(up == "HAVING", 5)
        .when(up == "QUALIFY", 6)
        .when((up == "BY") & (before == "ORDER"), 7)
        .when(up == "LIMIT", 8)
        .when(up.isin("UNION", "INTERSECT") | ((up == "EXCEPT") & ~before.endswith("*")), 0)
    )


def fault(words: Column) -> Column:
    """Why an array of tokens isn't one query, by its first fault; null: none was seen.

    not_a_query (it doesn't begin with SELECT, WITH, CREATE or a bracket, or selects nothing at all), foreign_characters (outside
    literals), unclosed_literal, unbalanced_brackets, unclosed_case, several_statements, trailing_semicolon, clause_order (a clause
    before one that must precede it, twice, or a second SELECT without a union), nothing_selected, empty_clause.  Comments don't count.
    Clauses are compared within their bracket, and only after its SELECT, so FROM and ORDER BY inside calls are none.
    """
    opened = lambda: F.struct(F.lit(0).alias("rank"), F.lit(0).alias("cases"))
    start = F.struct(F.lit(None).cast("string").alias("fault"), F.lit("").alias("before"), F.lit(False).alias("ended"), F.lit(False).alias("selects"), F.array(opened()).alias("open"))
    hangs = lambda before: F.when(before == "SELECT", "nothing_selected").when(before.isin(*HANGING), "empty_clause")

    def step(state: Column, token: Column) -> Column:
        # Bound once: what the next rules read several times.
        up, before = F.upper(token), state["before"]
        read = F.struct(up.alias("up"), _rank(up, before).alias("rank"), F.element_at(state["open"], -1).alias("top"), hangs(before).alias("hangs"))
        after = bound(read, lambda x: moved(state, x))
        return F.when(token.rlike(COMMENT) | state["fault"].isNotNull(), state).otherwise(after)

    def moved(state: Column, read: Column) -> Column:
        up, rank, top, hanging = read["up"], read["rank"], read["top"], read["hangs"]
        # A FROM or ORDER BY counts where its bracket has selected.
        clause = rank.isNotNull() & ((top["rank"] > 0) | (rank == 1))
        again = F.when(up == "JOIN", top["rank"] != 2).when(up == "FROM", top["rank"] != 1).otherwise(rank <= top["rank"])
        seen = (
            F.when(up == ";", F.lit(None).cast("string"))
            .when(state["ended"], "several_statements")
            .when((state["before"] == "") & ~up.isin("SELECT", "WITH", "CREATE", "("), "not_a_query")
            .when(up.isin(*TYPOGRAPHIC), "foreign_characters")
            .when(up.isin("'", '"', "`"), "unclosed_literal")
            .when((up == ")") & (F.size(state["open"]) == 1), "unbalanced_brackets")
            .when((up == ")") & (top["cases"] > 0), "unclosed_case")
            .when(up == ")", hanging)
            .when((up == "END") & (top["cases"] == 0), "unclosed_case")
            .when(hanging.isNotNull() & ((clause & (rank > 0)) | (up.isin("GROUP", "ORDER") & (top["rank"] > 0))), hanging)
            .when(clause & (rank > 0) & again, "clause_order")
        )
        frame = F.struct(F.when(clause, rank).otherwise(top["rank"]).alias("rank"), (top["cases"] + F.when(up == "CASE", 1).when(up == "END", -1).otherwise(0)).alias("cases"))
        lower = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)
        stack = (
            F.when(up == "(", F.concat(state["open"], F.array(opened())))
            .when((up == ")") & (F.size(state["open"]) > 1), lower)
            .when(clause | up.isin("CASE", "END"), F.concat(lower, F.array(frame)))
            .otherwise(state["open"])
        )
        return F.struct(seen.alias("fault"), F.when(up == ";", state["before"]).otherwise(up).alias("before"), (state["ended"] | (up == ";")).alias("ended"), (state["selects"] | (up == "SELECT")).alias("selects"), stack.alias("open"))

    def end(state: Column) -> Column:
        return (
            F.when(state["fault"].isNotNull(), state["fault"])
            .when((state["before"] == "") | ~state["selects"], "not_a_query")
            .when(F.size(state["open"]) > 1, "unbalanced_brackets")
            .when(F.element_at(state["open"], -1)["cases"] > 0, "unclosed_case")
            .when(hangs(state["before"]).isNotNull(), hangs(state["before"]))
            .when(state["ended"], "trailing_semicolon")
        )

    return F.aggregate(words, start, step, end)
