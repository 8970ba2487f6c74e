"""Registered queries of the gates: one model file, plan and set of artifacts for each customer, from templates with the customer's number.

The oracle SQL builds the expected findings from what each template lacks and the customer table; it never reads a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatica.corpus_queries import NEEDS, _checked, facts
from prismatica.operators import gates
from prismatica.registry import query
from prismatica.samples import values
from prismatica.sources import modelfiles

_GOOD = 'description: "Number of the row in its table"'
#: A file for each customer by number modulo 4: whole, poor, unreadable, and with joins in another order.
FILES = (
    f'view: t{{N}} {{ sql_table_name: dw.t{{N}} ;; dimension: id {{ primary_key: yes type: number label: "Id" tags: ["key"] {_GOOD} sql: ${{TABLE}}.id ;; }} dimension_group: made {{ type: time {_GOOD} sql: CAST(${{TABLE}}.made_on AS DATE) ;; sql_end: x ;; }} '
    f'measure: n {{ type: count label: "Rows" {_GOOD} value_format_name: decimal_0 }} }} view: t{{N}}_dt {{ derived_table: {{ sql: SELECT 1 ;; }} measure: n {{ type: sum sql: ${{id}} ;; value_format: "0.0" }} }} '
    "explore: t{N} { always_filter: { filters: [made: \"90 days\"] } join: b { sql_on: 1 ;; } join: a { sql_on: 1 ;; } }",
    f'view: t{{N}} {{ dimension: made {{ type: date description: "Day" sql: ${{TABLE}}.made_on ;; }} dimension: note {{ label: "Note" description: "{"long " * 41}" sql: ${{TABLE}}.note ;; }} measure: n {{ type: count }} measure: n {{ type: max sql: ${{id}} ;; }} }} explore: t{{N}} {{ join: b {{ sql_on: 1 ;; }} }}',
    "view: t{N} { dimension: id { sql: ${TABLE}.id ;; } } }",
    f'view: t{{N}} {{ sql_table_name: dw.t{{N}} ;; dimension: id {{ primary_key: yes {_GOOD} sql: ${{TABLE}}.id ;; }} dimension_group: m {{ type: time {_GOOD} sql: ${{TABLE}}.made_on ;; }} }} view: d {{ derived_table: {{ sql: SELECT 1 ;; }} }} explore: t{{N}} {{ join: a {{ sql_on: 1 ;; }} join: c {{ sql_on: 1 ;; }} join: b {{ sql_on: 1 ;; }} }}',
)


def _by_number(forms: tuple[str, ...]) -> Column:
    return F.replace(F.element_at(F.array(*map(F.lit, forms)), (F.col("c_custkey") % len(forms) + 1).cast("int")), F.lit("{N}"), F.col("c_custkey").cast("string"))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.concat(F.lit("t"), "c_custkey").alias("table"), F.concat(F.lit("views/t"), "c_custkey", F.lit(".view.lkml")).alias("path"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return _customers(spark, sf).select("table", "path", _by_number(FILES).alias("text"), "c_custkey")


_DATES = "array(named_struct('column', 'made_on', 'function', 'YEAR'), named_struct('column', 'made_on', 'function', 'DATE'))"
#: k, rule, level, finding of the files above, of tables with a CTE, a date and joins to b and then to a
_ENRICHED = [
    (1, "descriptions_missing", "warn", "2 fields without description"),
    (1, "descriptions_short", "warn", "3 descriptions under 15 characters"),
    (1, "descriptions_long", "warn", "1 descriptions over 200 characters"),
    (1, "derived_tables", "warn", "1 CTEs and no derived table"),
    (1, "primary_key", "warn", "no primary key"),
    (1, "plain_dates", "warn", "1 dates are plain dimensions"),
    (1, "sql_table_name", "warn", "no sql_table_name"),
    (1, "value_formats", "warn", "2 measures without value_format_name"),
    (1, "always_filter", "warn", "the explore has no always_filter"),
    (1, "questions", "warn", "no questions"),
    (2, "syntax", "block", "a block is closed too often"),
    (3, "always_filter", "warn", "the explore has no always_filter"),
    (3, "join_order", "block", "joins should stand in the order b, a"),
]
_FOUND = ("k", "rule", "level", "finding")


def _enrichment(spark: SparkSession, sf: str) -> DataFrame:
    rows = _customers(spark, sf)
    context = rows.select("table", F.array(F.lit("c")).alias("ctes"), F.expr(_DATES).alias("date_parts"))
    wanted = rows.select("table", F.expr("array(named_struct('right_table', 'b'), named_struct('right_table', 'a'), named_struct('right_table', 'b'))").alias("joins"))
    questions = rows.where("c_custkey % 4 <> 1").select("table", F.lit("Q").alias("query_id"), F.lit("how many").alias("question"))
    return gates.enrichment(_files(spark, sf).drop("c_custkey"), context, wanted, questions)


@query(f"SELECT 't' || c_custkey AS subject, rule, level, finding FROM customer JOIN {values(_ENRICHED, _FOUND)} ON c_custkey % 4 = k")
def enrichment_findings(spark, sf):
    return _enrichment(spark, sf)


@query("SELECT 't' || c_custkey AS subject, (ARRAY['pass', 'warn', 'fail', 'fail'])[c_custkey % 4 + 1] AS status, CAST((ARRAY[0, 0, 1, 1])[c_custkey % 4 + 1] AS BIGINT) AS blocking, CAST((ARRAY[0, 10, 0, 1])[c_custkey % 4 + 1] AS BIGINT) AS warnings FROM customer")
def enrichment_status(spark, sf):
    return gates.statuses(_customers(spark, sf).select(F.col("table").alias("subject")), _enrichment(spark, sf))


# --- what coverage says, against what was covered before -----------------------------------------------------------------------------

_LACKING = f"SELECT query_id, need, COALESCE(ok, c_mktsegment = 'BUILDING') AS covered FROM ({facts(NEEDS, 'need', 'f', 'col', 'parts', 'ok')}) JOIN customer ON c_custkey = query_id"


@query(
    f"WITH n AS ({_LACKING}), q AS (SELECT query_id, BOOL_AND(covered) AS ok, BOOL_OR(NOT covered AND need = 'structural') AS s, BOOL_OR(NOT covered AND need = 'join') AS j FROM n GROUP BY 1), p AS (SELECT COUNT(*) FILTER (WHERE ok) * 100.0 / COUNT(*) AS share FROM q) "
    "SELECT 'corpus' AS subject, 'coverage' AS rule, 'warn' AS level, PRINTF('%.1f%% of queries are covered', share) AS finding FROM p WHERE share < 90 "
    "UNION ALL SELECT CAST(query_id AS VARCHAR), 'structural_filters', 'warn', 'structural filters aren''t in the model' FROM q WHERE s UNION ALL SELECT CAST(query_id AS VARCHAR), 'join_paths', 'warn', 'joins aren''t in the model' FROM q WHERE j "
    "UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'regression', 'block', 'was covered before' FROM customer LEFT JOIN q ON query_id = c_custkey WHERE c_custkey % 3 = 0 AND NOT COALESCE(ok, false) "
    "UNION ALL SELECT 'views/t' || c_custkey || '.view.lkml', 'syntax', 'block', 'a block is closed too often' FROM customer WHERE c_custkey % 4 = 2"
)
def evaluation_findings(spark, sf):
    before = _customers(spark, sf).select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 3 == 0).alias("covered"))
    return gates.evaluation(_checked(spark, sf), before, modelfiles.faults(_files(spark, sf).select("path", "text")))


# --- before publishing ------------------------------------------------------------------------------------------------------------------

#: By number modulo 5: a JSON text, and whether it is one.
_JSON = [(0, '{"a": [1, {N}]}', True), (1, '[{N}', False), (2, "", False), (3, "null", True), (4, '{"a": 1} {N}', False)]
#: By number modulo 3: the lines of a view that change, of three.
_OLD = ("view: t{N} {\n  label: \"a\"\n}", "view: t{N} {\n  label: \"b\"\n}\n", "view: t{N} {\r\n  label: \"b\"\r\n}\r\n")
_NEW = ("view: t{N} {\n  label: \"a\"\n}\n", "view: t{N} {\n  label: \"c\"\n}\n", "view: t{N} {\n  label: \"b\"\n}\n")


@query(
    "SELECT 'views/t' || c_custkey || '.view.lkml' AS subject, 'changed' AS rule, 'warn' AS level, '67% changed' AS finding FROM customer WHERE c_custkey % 3 = 1 UNION ALL "
    f"SELECT 'a' || c_custkey || '.json', 'json', 'block', 'not JSON' FROM customer JOIN {values(_JSON, ('k', 'text', 'ok'))} ON c_custkey % 5 = k WHERE NOT ok UNION ALL "
    "SELECT name, 'artifact', 'warn', 'not there' FROM (VALUES ('metric_catalog.json'), ('filter_catalog.json'), ('golden_questions.json'), ('coverage_report.json')) t(name)"
)
def publish_findings(spark, sf):
    rows = _customers(spark, sf)
    artifacts = rows.select(F.concat(F.lit("a"), "c_custkey", F.lit(".json")).alias("name"), _by_number(tuple(t for _, t, _ in _JSON)).alias("text"))
    return gates.pre_publish(rows.select("path", _by_number(_NEW).alias("text")), rows.select("path", _by_number(_OLD).alias("text")), artifacts)


# --- plans ----------------------------------------------------------------------------------------------------------------------------

_PLAN = "The table holds one row for each customer and is joined by its key."
#: By number modulo 4: dimensions, measures, tokens, reasoning, questions, risks; the customers of 3 have no plan.  Only the plans of 1
#: have so many tokens for each number, those of the others don't grow with it.
_PLANS = ((2, 0, 10, _PLAN, 1, 1), (0, 0, 10_000, _PLAN, 3, 0), (0, 1, 10, "thin", 0, 0))
#: k, whether only for even tens, rule, level, finding
_PLAN_FACTS = [
    (1, "fields", "block", "'no dimension or measure'", "true"),
    (1, "tokens", "block", "c_custkey * 10000 || ' tokens'", "c_custkey * 10000 > 800000"),
    (1, "risks", "warn", "'CTEs or CASEs, and no risks'", "c_custkey // 10 % 2 = 0"),
    (2, "reasoning", "warn", "'4 characters of reasoning'", "true"),
    (2, "questions", "warn", "'no questions'", "true"),
    (2, "risks", "warn", "'CTEs or CASEs, and no risks'", "c_custkey // 10 % 2 = 0"),
    (3, "plan", "block", "'no plan'", "true"),
]


@query(" UNION ALL ".join(f"SELECT 't' || c_custkey AS subject, '{rule}' AS rule, '{level}' AS level, {finding} AS finding FROM customer WHERE c_custkey % 4 = {k} AND {when}" for k, rule, level, finding, when in _PLAN_FACTS))
def planning_findings(spark, sf):
    rows = _customers(spark, sf)
    # Tables of even tens have a CASE, or a CTE.
    odd = F.expr("c_custkey div 10 % 2 = 1")
    context = rows.select("table", F.when(odd | (F.col("c_custkey") % 2 == 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("c"))).alias("ctes"), F.when(odd | (F.col("c_custkey") % 2 == 1), 0).otherwise(2).alias("n_cases"))
    plan = F.element_at(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(p, ("dimensions", "measures", "tokens", "reasoning", "questions", "risks"), strict=True)]) for p in _PLANS]), (F.col("c_custkey") % 4 + 1).cast("int"))
    tokens = F.when(F.col("c_custkey") % 4 == 1, F.col("p.tokens") * F.col("c_custkey")).otherwise(F.col("p.tokens"))
    plans = rows.where("c_custkey % 4 < 3").select("c_custkey", "table", plan.alias("p")).select("table", "p.dimensions", "p.measures", tokens.alias("tokens"), "p.reasoning", "p.questions", "p.risks")
    return gates.planning(plans, context)


# --- filters, measures and quality --------------------------------------------------------------------------------------------------------


@query(
    "WITH used AS (SELECT o_orderpriority AS tbl, o_orderstatus AS col, CASE WHEN o_custkey % 3 = 0 THEN '=' WHEN o_custkey % 3 = 1 THEN 'IN' ELSE '!=' END AS op FROM orders) "
    "SELECT DISTINCT tbl || '.' || col AS subject, 'catalog' AS rule, 'warn' AS level, 'not in the catalog' AS finding FROM used WHERE col = 'P' "
    "UNION ALL SELECT tbl || '.' || col, 'operator', 'block', 'not allowed: ' || STRING_AGG(DISTINCT op, ', ' ORDER BY op) FROM used WHERE (col = 'F' AND op = 'IN') OR col = 'O' GROUP BY ALL"
)
def filter_operator_findings(spark, sf):
    op = F.element_at(F.array(F.lit("="), F.lit("in"), F.lit("<>")), (F.col("o_custkey") % 3 + 1).cast("int"))
    used = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("table"), F.col("o_orderstatus").alias("column"), op.alias("operator"))
    entries = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("table"), F.col("o_orderstatus").alias("column"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("="), F.lit("!="))).otherwise(F.array().cast("array<string>")).alias("operators"))
    return gates.filter_operators(used, entries.dropDuplicates(["table", "column"]))


#: Fixed values by number modulo 4.  A date inside a call is not a word of its own.
_SIGNALS = [(0, 1, 0, 0, 0, 0, 1, 0, 1, True), (1, 2, 0, 1, 1, 2, 2, 2, 1, False), (3, 1, 0, 0, 1, 1, 0, 0, 0, True)]
_SIGNAL_COLUMNS = ("dims_total", "dims_missing_description", "dims_short_description", "dims_missing_label", "dims_missing_tags", "measures_total", "measures_missing_value_format", "dates_as_plain_dim", "has_primary_key")


@query(f"SELECT 'views/t' || c_custkey || '.view.lkml' AS path, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _SIGNAL_COLUMNS[:-1])}, has_primary_key FROM customer JOIN {values(_SIGNALS, ('k', *_SIGNAL_COLUMNS))} ON c_custkey % 4 = k")
def quality_signals(spark, sf):
    dates = _customers(spark, sf).select("path", F.array(F.lit("MADE_ON")).alias("dates"))
    return gates.quality_signals(_files(spark, sf), dates)


_METRICS = [
    (0, "t{N}.n", "count", "Rows", "Number of the row in its table", "decimal_0", None),
    (0, "t{N}_dt.n", "sum", None, None, "0.0", "${id}"),
    (1, "t{N}.n", "count", None, None, None, None),
]


@query(f"SELECT REPLACE(metric, '{{N}}', CAST(c_custkey AS VARCHAR)) AS metric, 'views/t' || c_custkey || '.view.lkml' AS path, type, label, description, value_format, sql FROM customer JOIN {values(_METRICS, ('k', 'metric', 'type', 'label', 'description', 'value_format', 'sql'))} ON c_custkey % 4 = k")
def metrics_of_files(spark, sf):
    return gates.metric_catalog(modelfiles.fields(modelfiles.blocks(_files(spark, sf).select("path", "text"))))
