"""Registered queries over metadata answers that grow with the tables: two cached answers and perhaps a fetched one for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatica.registry import query
from prismatica.sources import freshness

AS_OF = "TIMESTAMP '2026-01-02 00:00:00'"
#: By c_custkey % 6: the answer, in the shapes of several years.  {N}: the customer's number, {S}: the segment.
SHAPES = (
    '{"canonical_name": "Customer {N}", "definition": "One of {S}", "synonyms": ["a", "{S}"], "entity_type": "party", "columns": [{"name": "id", "description": "Number"}, {"name": "seg", "description": " "}, {"description": "no name"}, {"name": "id", "definition": "{S}"}]}',
    '{"display_name": "Client {N}", "description": "", "aliases": ["x"], "columns": [], "attributes": {"id": {"description": "{S}"}, "odd": 3}}',
    '{"canonical_name": "", "fields": [{"name": "f{N}"}], "synonyms": []}',
    '["{S}"]',
    '{"columns": "{S}", "definition": "{S}"}',
    '{"canonical_name": "{S}',
)


def _answered(spark: SparkSession, sf: str) -> DataFrame:
    """Cached k % 40 hours before the moment (and, as something else, an hour after it); every fourth was never cached."""
    made = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment", F.concat(F.lit("c_"), "c_custkey", F.lit("-"), F.lower("c_mktsegment")).alias("table"))
    text = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("c_custkey") % len(SHAPES) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{N}"), F.col("c_custkey").cast("string")), F.lit("{S}"), F.col("c_mktsegment"))
    as_of = F.lit("2026-01-02 00:00:00").cast("timestamp")
    hours = F.make_dt_interval(hours=(F.col("c_custkey") % 40).cast("int"))
    kept = made.where("c_custkey % 4 <> 3")
    cached = kept.select("table", (as_of - hours).alias("modified"), text.alias("text")).unionByName(kept.select("table", (as_of + F.expr("INTERVAL 1 HOUR")).alias("modified"), F.lit("{}").alias("text")))
    code = F.element_at(F.array(*[F.lit(c).cast("int") for c in (200, 404, 500, None, 204)]), (F.col("c_custkey") % 5 + 1).cast("int"))
    fetched = made.where("c_custkey % 7 <> 0").select("table", code.alias("code"), F.when(code.isNotNull(), F.when(code == 500, F.lit("down")).otherwise(text)).alias("text"))
    return freshness.answers(made, cached, fetched, as_of)


_KEY = "'c_' || c_custkey || '-' || LOWER(c_mktsegment)"
_STATE = (
    f"(SELECT *, {_KEY} AS tbl, c_custkey % 6 AS shape, c_custkey % 6 NOT IN (3, 5) AS object, c_custkey % 4 <> 3 AS kept, c_custkey % 40 <= 24 AS young, "
    "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE [200, 404, 500, NULL, 204][CAST(c_custkey % 5 + 1 AS INT)] END AS code, c_custkey % 7 <> 0 AS asked FROM customer)"
)
_CHOSEN = (
    f"(SELECT *, CASE WHEN kept AND young AND object THEN 'cache' WHEN code IS NULL OR code = 404 THEN 'fallback' ELSE 'api' END AS source, "
    "CASE WHEN kept AND young AND object THEN NULL WHEN NOT kept THEN 'absent' WHEN young THEN 'unreadable' ELSE 'stale' END AS missed, "
    "CASE WHEN kept AND young AND object THEN NULL WHEN NOT asked THEN 'not fetched' WHEN code IS NULL THEN 'no answer' WHEN code = 404 THEN '404' WHEN code = 500 THEN 'HTTP 500: down' WHEN NOT object THEN 'not a JSON object' END AS reason "
    f"FROM {_STATE})"
)
_GOOD = f"(SELECT * FROM {_CHOSEN} WHERE source <> 'api' OR reason IS NULL)"


@query(f'SELECT tbl AS "table", source, CASE WHEN source = \'api\' AND reason IS NOT NULL THEN \'error\' ELSE \'success\' END AS status, missed, reason FROM {_CHOSEN}')
def fresh_answers(spark, sf):
    return _answered(spark, sf).select("table", "source", "status", "missed", "reason")


@query(f"SELECT missed, source, COUNT(*) AS n FROM {_CHOSEN} WHERE missed IS NOT NULL GROUP BY ALL")
def cache_misses(spark, sf):
    return freshness.misses(_answered(spark, sf)).groupBy("missed", "source").agg(F.count("*").alias("n"))


_LABEL = "'C ' || c_custkey || ' ' || UPPER(LEFT(c_mktsegment, 1)) || LOWER(SUBSTR(c_mktsegment, 2))"


@query(
    f"SELECT tbl AS \"table\", source, CASE WHEN source = 'fallback' THEN {_LABEL} WHEN shape = 0 THEN 'Customer ' || c_custkey WHEN shape = 1 THEN 'Client ' || c_custkey ELSE tbl END AS canonical_name, "
    "CASE WHEN source = 'fallback' THEN '' WHEN shape = 0 THEN 'One of ' || c_mktsegment WHEN shape = 4 THEN c_mktsegment ELSE '' END AS definition, "
    "CASE WHEN source = 'fallback' THEN '' WHEN shape = 0 THEN 'a,' || c_mktsegment WHEN shape = 1 THEN 'x' ELSE '' END AS synonyms, CASE WHEN source <> 'fallback' AND shape = 0 THEN 'party' END AS entity_type, "
    "CAST(CASE WHEN source = 'fallback' THEN 0 ELSE [2, 2, 1, 0, 0, 0][CAST(shape + 1 AS INT)] END AS BIGINT) AS n_columns, CASE WHEN source <> 'fallback' AND shape < 2 THEN 0.5 ELSE 0.0 END AS coverage "
    f"FROM {_GOOD}"
)
def metadata_digests(spark, sf):
    return freshness.digests(_answered(spark, sf)).withColumn("synonyms", F.array_join("synonyms", ","))


@query(
    f"SELECT tbl AS \"table\", name, description FROM (SELECT tbl, shape AS s, c_custkey AS n, c_mktsegment AS seg FROM {_GOOD} WHERE source <> 'fallback') g JOIN LATERAL (SELECT * FROM (VALUES (0, 'id', seg), (0, 'seg', NULL), (1, 'id', seg), (1, 'odd', NULL), (2, 'f' || n, NULL)) v(k, name, description)) ON k = s"
)
def legacy_columns(spark, sf):
    return freshness.columns(_answered(spark, sf)).select("table", "name", "description")
