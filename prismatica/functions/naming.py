"""Names, labels and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name prefix and warehouse format of each measure type.
MEASURE_PREFIX = {"sum": "total", "count": "count", "count_distinct": "unique", "average": "avg", "min": "min", "max": "max"}
#: Warehouse types of number and yesno dimensions; all others are strings.
NUMBER_TYPES = ("NUMERIC", "FLOAT64", "INT64", "INTEGER", "NUMBER")
YESNO_TYPES = ("BOOL", "BOOLEAN")
KEY_SUFFIX = "(_id|_xref_id|_uuid|_key|_cd)$"


def label(name: Column) -> Column:
    """snake_case to Title Case."""
    return F.initcap(F.trim(F.regexp_replace(F.trim(name), "[-_]+", " ")))


def dimension_group_name(name: Column) -> Column:
    """The name without one trailing date suffix; the name itself if nothing would be left."""
    short = F.regexp_replace(name, "(_dt|_date|_ts|_timestamp)$", "")
    return F.when(short == "", name).otherwise(short)


def measure_name(kind: Column, column: Column) -> Column:
    prefix = F.create_map(*[F.lit(x) for pair in MEASURE_PREFIX.items() for x in pair])
    return F.concat_ws("_", F.coalesce(prefix[kind], kind), column)


def dimension_type(warehouse: Column) -> Column:
    upper = F.upper(warehouse)
    return F.when(upper.isin(*NUMBER_TYPES), "number").when(upper.isin(*YESNO_TYPES), "yesno").otherwise("string")


def safe_key(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def tokens(text: Column) -> Column:
    """Distinct lower-cased identifiers of more than two characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9_]*)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 2))


def references(sql: Column) -> Column:
    """Names inside ${...}."""
    return F.regexp_extract_all(sql, F.lit(r"\$\{([a-zA-Z_][a-zA-Z0-9_.]*)\}"), F.lit(1))


def shortened(text: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters with pipes escaped, for tables in reports."""
    line = F.regexp_replace(F.regexp_replace(text, "[\r\n]+", " "), r"\|", r"\\\\|")
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)


def is_key_candidate(name: Column) -> Column:
    return F.lower(name).rlike(KEY_SUFFIX)


def token_estimate(columns: Column, view_chars: Column, aggregations: Column, cte_chars: Column) -> Column:
    """Size of an enrichment request; ``cte_chars`` is an array of the lengths of the CTE texts."""
    ctes = F.aggregate(cte_chars, F.lit(0).cast("bigint"), lambda a, x: a + F.floor(x / 4))
    return F.lit(4000) + columns * 25 + F.floor(view_chars / 4) + aggregations * 30 + ctes
