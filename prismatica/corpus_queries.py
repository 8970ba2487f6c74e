"""Registered queries over a corpus of SQL statements that grows with the tables: one statement for each customer.

Statements come from a few templates with the customer's values, so what a statement says is known by its template.  The oracle SQL
builds the expected facets from those facts and the customer table; it never reads a statement.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatica.operators import containment, corpus, coverage, fields, proposals, repair
from prismatica.operators.lineage import cut
from prismatica.registry import query
from prismatica.samples import for_customers, values, values_for_customers
from prismatica.sources.corpus import model_file_kind, numbered, preview, resolve_baselines, row_range, sheet_sizes

TEMPLATES = (
    "SELECT o_orderpriority, SUM(o_totalprice) AS total FROM dw.orders WHERE o_orderstatus = '{S}' AND o_totalprice >= -{P} AND o_comment != 'from here -- where x = 1' GROUP BY o_orderpriority",
    "WITH final AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = '{S}' AND EXTRACT(YEAR FROM o_orderdate) = 1996), rich AS (SELECT c_custkey FROM customer WHERE c_acctbal >= {P}) "
    "SELECT COUNT(DISTINCT f.o_custkey) AS n FROM final f LEFT JOIN rich r ON f.o_custkey = r.c_custkey",
    "SELECT CASE WHEN o_totalprice >= {P} THEN 'large' WHEN o_totalprice > 10 THEN 'small' ELSE 'none' END AS band, AVG(o_totalprice) FROM orders o, customer c "
    "WHERE o.o_custkey = c.c_custkey AND o_orderstatus IN ('{S}', 'X') AND NOT o_orderpriority LIKE '1%' GROUP BY 1",
    "SET x = 1; SELECT DATE_TRUNC(l_shipdate, MONTH) AS m, MIN(l_quantity), MAX(l_extendedprice * 2) AS big FROM `my-dw.sales.lineitem` INNER JOIN part ON l_partkey = p_partkey "
    "JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = 3 WHERE l_shipdate BETWEEN '1996-01-01' AND '1996-12-31' AND l_comment IS NOT NULL AND LOWER(l_returnflag) = 'r';",
    "CREATE OR REPLACE TEMP TABLE tmp_orders AS SELECT * FROM orders /* from nowhere */ WHERE o_orderstatus NOT IN ('{S}')",
    " '' ; ",
    "CALL refresh('{S}')",
)
#: Fixed values by template (k), in the order in which a statement says them.  {S} and {P} stand for the customer's values.
TABLES = [(0, "orders"), (1, "orders"), (1, "customer"), (2, "orders"), (2, "customer"), (3, "lineitem"), (3, "part"), (3, "supplier"), (4, "orders")]
PREDICATES = [
    (0, "o_orderstatus", "=", "'{S}'", False, True),
    (0, "o_totalprice", ">=", "-{P}", False, True),
    (0, "o_comment", "!=", "'from here -- where x = 1'", False, True),
    (1, "o_orderstatus", "=", "'{S}'", False, False),
    (1, "o_orderdate", "=", "1996", False, False),
    (1, "c_acctbal", ">=", "{P}", False, False),
    (2, "o_custkey", "=", "c.c_custkey", False, True),
    (2, "o_orderstatus", "IN", "('{S}', 'X')", False, True),
    (2, "o_orderpriority", "LIKE", "'1%'", True, True),
    (3, "l_shipdate", "BETWEEN", "'1996-01-01' AND '1996-12-31'", False, True),
    (3, "l_comment", "IS", "NULL", True, True),
    (3, "l_returnflag", "=", "'r'", False, True),
    (4, "o_orderstatus", "IN", "('{S}')", True, True),
]
AGGREGATIONS = [(0, "SUM", "o_totalprice", False, "total"), (1, "COUNT", "o_custkey", True, "n"), (2, "AVG", "o_totalprice", False, None), (3, "MIN", "l_quantity", False, None), (3, "MAX", None, False, "big")]
JOINS = [(1, 1, "left", "rich", "o_custkey", "c_custkey"), (3, 1, "inner", "part", "l_partkey", "p_partkey"), (3, 2, "inner", "supplier", None, None)]
CASES = [(2, "band", "o_totalprice", "o_totalprice >= {P}", "large"), (2, "band", "o_totalprice", "o_totalprice > 10", "small")]
CTES = [
    (1, "final", "SELECT o_custkey , o_totalprice FROM orders WHERE o_orderstatus = '{S}' AND EXTRACT ( YEAR FROM o_orderdate ) = 1996", "orders", 2),
    (1, "rich", "SELECT c_custkey FROM customer WHERE c_acctbal >= {P}", "customer", 1),
]
CREATED = [(4, "tmp_orders", "SELECT * FROM orders WHERE o_orderstatus NOT IN ( '{S}' )", True, True)]
DIMENSIONS = [(0, "o_orderpriority"), (1, "o_custkey"), (1, "o_totalprice"), (1, "c_custkey")]
DATES = [(1, "o_orderdate", "YEAR"), (3, "l_shipdate", "MONTH")]
SUMMARY = [(0, None, "simple", True), (1, None, "complex", True), (2, None, "medium", True), (3, None, "complex", True), (4, None, "simple", False), (5, "empty_input", "unknown", False), (6, "not_a_query", "unknown", False)]


def statements_of_customers(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, prompt, sql: one statement for each customer."""
    return _from_templates(spark, sf, TEMPLATES)


def _from_templates(spark: SparkSession, sf: str, templates: tuple[str, ...]) -> DataFrame:
    made = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal")
    template = F.element_at(F.array(*map(F.lit, templates)), (F.col("c_custkey") % len(templates) + 1).cast("int"))
    amount = F.floor(F.abs("c_acctbal")).cast("bigint").cast("string")
    sql = F.replace(F.replace(template, F.lit("{S}"), F.col("c_mktsegment")), F.lit("{P}"), amount)
    return made.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("totals of "), F.lower("c_mktsegment")).alias("prompt"), sql.alias("sql"))


@lru_cache(maxsize=4)
def prints(spark: SparkSession, sf: str) -> DataFrame:
    """The declared fingerprints; only the plan is kept."""
    return corpus.fingerprints(statements_of_customers(spark, sf))


def facts(rows: list[tuple], *columns: str) -> str:
    """SQL of the facts for every customer, values filled in."""
    filled = [f"REPLACE(REPLACE({c}, '{{S}}', c_mktsegment), '{{P}}', CAST(CAST(FLOOR(ABS(c_acctbal)) AS BIGINT) AS VARCHAR)) AS {c}" if any("{" in str(r[i + 1]) for r in rows) else c for i, c in enumerate(columns)]
    return f"SELECT c_custkey AS query_id, {', '.join(filled)} FROM customer JOIN {values(rows, ('k', *columns))} ON c_custkey % {len(TEMPLATES)} = k"


_USED = facts(TABLES, "tbl")


@query(f'SELECT query_id, tbl AS "table" FROM ({_USED})')
def table_queries(spark, sf):
    return corpus.table_queries(prints(spark, sf))


@query(f'SELECT tbl AS "table", COUNT(*) AS query_count FROM ({_USED}) GROUP BY tbl')
def table_manifest(spark, sf):
    return corpus.table_manifest(prints(spark, sf))


@query(f'SELECT query_id, col AS "column", op AS operator, val AS value, neg AS negated, main FROM ({facts(PREDICATES, "col", "op", "val", "neg", "main")})')
def sql_predicates(spark, sf):
    return prints(spark, sf).select("query_id", F.explode("predicates").alias("p")).select("query_id", "p.column", "p.operator", "p.value", "p.negated", (F.col("p.scope") == 0).alias("main"))


@query(f"SELECT query_id, col AS \"column\", val AS value FROM ({facts([p for p in PREDICATES if p[2] == '=' and '.' not in p[3]], 'col', 'op', 'val', 'neg', 'main')})")
def sql_equalities(spark, sf):
    return prints(spark, sf).select("query_id", F.explode("equality_filters").alias("f")).select("query_id", "f.column", "f.value")


@query(f'SELECT query_id, f AS function, col AS "column", dist AS "distinct", alias FROM ({facts(AGGREGATIONS, "f", "col", "dist", "alias")})')
def aggregations(spark, sf):
    return prints(spark, sf).select("query_id", F.explode("aggregations").alias("a")).select("query_id", "a.*")


@query(f'SELECT query_id, pos AS position, kind, tbl AS "table", l AS left_key, r AS right_key FROM ({facts(JOINS, "pos", "kind", "tbl", "l", "r")})')
def sql_joins(spark, sf):
    return prints(spark, sf).select("query_id", F.explode("joins").alias("j")).select("query_id", "j.position", "j.kind", "j.table", "j.left_key", "j.right_key")


@query(f'SELECT query_id, alias, col AS "column", w AS "when", t AS "then" FROM ({facts(CASES, "alias", "col", "w", "t")})')
def sql_cases(spark, sf):
    return prints(spark, sf).select("query_id", F.explode("cases").alias("c")).select("query_id", "c.alias", "c.column", F.explode("c.branches").alias("b")).select("query_id", "alias", "column", "b.when", "b.then")


@query(f"SELECT query_id, alias, body, src AS sources, CAST(n AS BIGINT) AS filters FROM ({facts(CTES, 'alias', 'body', 'src', 'n')})")
def sql_ctes(spark, sf):
    return prints(spark, sf).select("query_id", F.explode("cte_parts").alias("c")).select("query_id", "c.alias", "c.body", F.array_join("c.sources", ",").alias("sources"), F.size("c.filters").cast("bigint").alias("filters"))


@query(f"SELECT query_id, alias, body, temp AS is_temp, rep AS is_replace FROM ({facts(CREATED, 'alias', 'body', 'temp', 'rep')})")
def sql_created(spark, sf):
    return prints(spark, sf).select("query_id", F.explode("created").alias("c")).select("query_id", "c.*")


@query(f'SELECT query_id, col AS "column" FROM ({facts(DIMENSIONS, "col")})')
def sql_dimensions(spark, sf):
    return prints(spark, sf).select("query_id", F.explode("dimensions").alias("column"))


@query(f'SELECT query_id, col AS "column", f AS function FROM ({facts(DATES, "col", "f")})')
def sql_dates(spark, sf):
    return prints(spark, sf).select("query_id", F.explode("date_parts").alias("d")).select("query_id", "d.*")


@query(f"SELECT query_id, err AS parse_error, cls AS complexity, ready, COALESCE(j, 0) AS join_count, COALESCE(a, 0) AS agg_count FROM ({facts(SUMMARY, 'err', 'cls', 'ready')}) s LEFT JOIN (SELECT query_id AS q, COUNT(*) AS j FROM ({facts(JOINS, 'pos', 'kind', 'tbl', 'l', 'r')}) GROUP BY 1) ON q = query_id LEFT JOIN (SELECT query_id AS q2, COUNT(*) AS a FROM ({facts(AGGREGATIONS, 'f', 'col', 'dist', 'alias')}) GROUP BY 1) ON q2 = query_id")
def complexity(spark, sf):
    return prints(spark, sf).select("query_id", "parse_error", "complexity", "ready", F.size("joins").cast("bigint").alias("join_count"), F.size("aggregations").cast("bigint").alias("agg_count"))


def _shares(n: str) -> str:
    return f"(SELECT COUNT(*) FROM customer WHERE c_custkey % {len(TEMPLATES)} = {n})"


@query(
    f"SELECT signature, COUNT(*) AS support FROM ({facts([(1, 'customer|orders / left rich o_custkey=c_custkey'), (2, 'customer|orders / '), (3, 'lineitem|part|supplier / inner part l_partkey=p_partkey, inner supplier ')], 'signature')}) GROUP BY signature"
)
def join_patterns(spark, sf):
    return corpus.join_patterns(prints(spark, sf))


_CONTEXT = (
    f"used AS ({_USED}), q AS (SELECT tbl, COUNT(*) AS n FROM used GROUP BY tbl), a AS (SELECT tbl, COUNT(DISTINCT CONCAT_WS('|', f, COALESCE(col, '*'), dist)) AS n FROM used JOIN ({facts(AGGREGATIONS, 'f', 'col', 'dist', 'alias')}) USING (query_id) GROUP BY tbl), "
    f"c AS (SELECT tbl, COUNT(DISTINCT alias) AS n FROM used JOIN ({facts(CTES, 'alias', 'body', 'src', 'n')}) USING (query_id) GROUP BY tbl), w AS (SELECT tbl, COUNT(*) AS n FROM used JOIN (SELECT DISTINCT query_id FROM ({facts(CASES, 'alias', 'col', 'w', 't')})) USING (query_id) GROUP BY tbl), "
    f"p AS (SELECT tbl, STRING_AGG(DISTINCT col, ',' ORDER BY col) AS cols FROM used JOIN ({facts(PREDICATES, 'col', 'op', 'val', 'neg', 'main')}) USING (query_id) GROUP BY tbl)"
)


@query(f'WITH {_CONTEXT} SELECT q.tbl AS "table", q.n AS queries, q.n * (1 + COALESCE(a.n, 0) + COALESCE(c.n, 0) + COALESCE(w.n, 0)) AS score, ROW_NUMBER() OVER (ORDER BY q.n DESC, q.tbl) AS place FROM q LEFT JOIN a USING (tbl) LEFT JOIN c USING (tbl) LEFT JOIN w USING (tbl)')
def priority(spark, sf):
    return corpus.priorities(prints(spark, sf))


_DESCRIBED = [("orders", 0.5), ("customer", 1.0), ("part", 0.2)]


@query(f"WITH {_CONTEXT}, m AS (SELECT * FROM {values(_DESCRIBED, ('tbl', 'cov'))}) SELECT q.tbl AS \"table\", q.n AS queries, COALESCE(p.cols, '') AS filters, COALESCE(a.n, 0) AS n_aggregations, CAST(COALESCE(cov, 0) AS DOUBLE) AS coverage FROM q LEFT JOIN p USING (tbl) LEFT JOIN a USING (tbl) LEFT JOIN m USING (tbl)")
def corpus_summary(spark, sf):
    context = corpus.table_context(prints(spark, sf), spark.createDataFrame(_DESCRIBED, "table string, coverage double"))
    return context.select("table", "queries", F.array_join("filter_columns", ",").alias("filters"), F.size("aggregations").cast("bigint").alias("n_aggregations"), "coverage")


_BRIEFS = [
    ("orders", "- Read by CTEs: `final`, `rich`\n- Read by temporary tables: `tmp_orders`\n"),
    ("customer", "- Read by CTEs: `final`, `rich`\n"),
    ("lineitem", "- Joined with: `part`, `supplier`\n"),
    ("part", "- Joined with: `lineitem`\n"),
    ("supplier", "- Joined with: `lineitem`\n"),
]


@query(f"SELECT tbl AS \"table\", head || '- Queries: ' || COUNT(*) AS brief FROM ({_USED}) JOIN {values(_BRIEFS, ('tbl', 'head'))} USING (tbl) GROUP BY tbl, head")
def table_briefs(spark, sf):
    return corpus.briefs(corpus.table_context(prints(spark, sf)))


@query(f"SELECT DISTINCT src AS \"table\", alias AS cte, col AS \"column\", op AS operator, val AS value FROM ({facts([(1, 'orders', 'final', 'o_orderstatus', '=', chr(39) + '{S}' + chr(39)), (1, 'orders', 'final', 'o_orderdate', '=', '1996'), (1, 'customer', 'rich', 'c_acctbal', '>=', '{P}')], 'src', 'alias', 'col', 'op', 'val')})")
def structural_filters(spark, sf):
    return corpus.structural_filters(prints(spark, sf))


@query(f"WITH {_CONTEXT} SELECT query_id, STRING_AGG(DISTINCT tbl, ',' ORDER BY tbl) AS \"tables\", ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(FLATTEN(LIST(STRING_SPLIT(cols, ','))))), ',') AS filters FROM used JOIN p USING (tbl) GROUP BY query_id")
def facets_by_query(spark, sf):
    f = prints(spark, sf)
    return corpus.per_query(corpus.table_context(f), f).select("query_id", F.array_join("tables", ",").alias("tables"), F.array_join("filter_columns", ",").alias("filters"))


@query(f"SELECT query_id, CASE WHEN tbl = 'orders' THEN 'order_view' ELSE tbl END AS view FROM ({facts([(0, 'orders'), (1, 'orders'), (2, 'orders'), (3, 'lineitem'), (4, 'orders')], 'tbl')})")
def queries_by_view(spark, sf):
    return corpus.by_view(prints(spark, sf), spark.createDataFrame([("orders", "order_view")], "table string, view string")).select("query_id", "view")


@query(f"SELECT tbl AS \"table\", col AS \"column\", op AS operator, COUNT(*) AS n FROM ({facts(PREDICATES, 'col', 'op', 'val', 'neg', 'main')}) JOIN ({facts([(0, 'orders'), (1, 'orders'), (2, 'orders'), (3, 'lineitem'), (4, 'orders')], 'tbl')}) USING (query_id) WHERE main GROUP BY ALL")
def filter_catalog(spark, sf):
    return proposals.filter_catalog(corpus.by_view(prints(spark, sf)))


@query(f"SELECT tbl AS \"table\", query_id, 'totals of ' || LOWER(TRIM(c_mktsegment)) AS question FROM ({facts([(0, 'orders'), (1, 'orders'), (2, 'orders'), (3, 'lineitem'), (4, 'orders')], 'tbl')}) JOIN customer ON c_custkey = query_id")
def golden_questions(spark, sf):
    return proposals.golden_questions(corpus.by_view(prints(spark, sf)))


@query(
    "SELECT * FROM (VALUES ('orders', '', 'o_orderdate: last 90 days'), ('lineitem', '1 part l_partkey=p_partkey inner,2 supplier inner', 'l_shipdate: last 90 days')) t(\"table\", joins, always_filter)"
)
def propose_explores(spark, sf):
    out = proposals.propose_explores(prints(spark, sf))
    written = F.transform("joins", lambda j: F.concat_ws(" ", j["position"].cast("string"), j["right_table"], F.when(j["left_key"].isNotNull(), F.concat_ws("=", j["left_key"], j["right_key"])), j["kind"]))
    return out.select("table", F.array_join(written, ",").alias("joins"), "always_filter")


# --- a small model, and whether it answers the corpus -----------------------------------------------------------------------------

FIELDS = [
    ("orders", "dimension", "o_orderkey", "number", "${TABLE}.o_orderkey", "Key", "Unique number of an order in the warehouse", ["primary_key"]),
    ("orders", "dimension", "o_orderpriority", "string", "${TABLE}.o_orderpriority", "Priority", "Short", ["p"]),
    ("orders", "dimension", "o_orderstatus", "string", "${TABLE}.o_orderstatus", "", "", []),
    ("orders", "dimension", "size_band", "string", "CASE WHEN ${TABLE}.o_totalprice > 1 THEN 'large' ELSE 'small' END", "Band", "Large and small orders, by their total price", ["b"]),
    ("orders", "dimension", "ship_date", "date", "${TABLE}.ship_date", "Shipped", "Day on which the order was sent, if it was", ["d"]),
    ("orders", "measure", "total_price", "sum", "${TABLE}.o_totalprice", "Total", "Sum of the prices of orders", []),
    ("final_dt", "dimension", "o_custkey", "number", "${TABLE}.o_custkey", "Customer", "Number of the customer who placed it", ["c"]),
    ("lineitem", "measure", "least_quantity", "min", "${TABLE}.l_quantity", "Least", "Least quantity of a line", []),
]
VIEWS = [("orders", "orders", None), ("customer", "customer", None), ("lineitem", "lineitem", None), ("final_dt", None, "SELECT o_custkey FROM orders WHERE o_orderstatus = 'BUILDING' AND EXTRACT(YEAR FROM o_orderdate) = 1996")]
EXPLORES = [("orders", "orders", None, [("customer", "${o_custkey} = ${c_custkey}", "many_to_one")]), ("lines", "lineitem", None, [("part", "", "many_to_one")])]
#: Fixed values by template: need, function, column, parts (comma-joined), and whether the model above answers it; null: only for BUILDING.
NEEDS = [
    (0, "table", None, "orders", "", True),
    (0, "measure", "SUM", "o_totalprice", "", True),
    (0, "dimension", None, "o_orderpriority", "", True),
    (0, "dimension", None, "o_orderstatus", "", True),
    (0, "dimension", None, "o_totalprice", "", True),
    (0, "dimension", None, "o_comment", "", False),
    (1, "table", None, "orders", "", True),
    (1, "table", None, "customer", "", True),
    (1, "measure", "COUNT", "o_custkey", "", False),
    (1, "dimension", None, "o_custkey", "", True),
    (1, "dimension", None, "o_totalprice", "", True),
    (1, "dimension", None, "c_custkey", "", False),
    (1, "derived", None, "final", "o_orderstatus,o_orderdate", True),
    (1, "derived", None, "rich", "c_acctbal", False),
    (1, "structural", None, "o_orderstatus", "o_orderstatus,{S}", None),
    (1, "structural", None, "o_orderdate", "o_orderdate,1996", True),
    (1, "structural", None, "c_acctbal", "c_acctbal,{P}", False),
    (2, "table", None, "orders", "", True),
    (2, "table", None, "customer", "", True),
    (2, "measure", "AVG", "o_totalprice", "", False),
    (2, "dimension", None, "o_custkey", "", True),
    (2, "dimension", None, "o_orderstatus", "", True),
    (2, "dimension", None, "o_orderpriority", "", True),
    (2, "case", None, "band", "large,small", True),
    (3, "table", None, "lineitem", "", True),
    (3, "table", None, "part", "", False),
    (3, "table", None, "supplier", "", False),
    (3, "join", None, "part", "lineitem", False),
    (3, "join", None, "supplier", "lineitem", False),
    (3, "measure", "MIN", "l_quantity", "", True),
    (3, "measure", "MAX", None, "", False),
    (3, "dimension", None, "l_shipdate", "", False),
    (3, "dimension", None, "l_comment", "", False),
    (3, "dimension", None, "l_returnflag", "", False),
    (4, "table", None, "orders", "", True),
    (4, "dimension", None, "o_orderstatus", "", True),
    (4, "derived", None, "tmp_orders", "", False),
]
_NEEDED = f"SELECT query_id, need, f, col, LOWER(parts) AS parts, COALESCE(ok, c_mktsegment = 'BUILDING') AS covered FROM ({facts(NEEDS, 'need', 'f', 'col', 'parts', 'ok')}) JOIN customer ON c_custkey = query_id"


_FIELD_TYPES = "view string, kind string, name string, type string, sql string, label string, description string, tags array<string>"


def fields_for_customers(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of the model, once more for the views of each customer."""
    return for_customers(spark, sf, FIELDS, _FIELD_TYPES, "view")


def model(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(FIELDS, _FIELD_TYPES),
        spark.createDataFrame(VIEWS, "view string, table string, derived string"),
        spark.createDataFrame(EXPLORES, "explore string, base string, always_where string, joins array<struct<view:string,sql_on:string,relationship:string>>"),
    )


def _checked(spark, sf):
    return coverage.check(coverage.needs(prints(spark, sf)), *model(spark))


@query(f'SELECT query_id, need, f AS function, col AS "column", parts, covered FROM ({_NEEDED})')
def model_coverage(spark, sf):
    return _checked(spark, sf).select("query_id", "need", "function", "column", F.array_join("parts", ",").alias("parts"), "covered")


#: The model with names that are only parts of its words.
_TEXT_FIELDS = [
    *[(*f[:5],) for f in FIELDS],
    ("orders", "measure", "mean", "average", "${TABLE}.o_totalprice_usd"),
    ("lineitem", "dimension_group", "made", "time", "CAST(${TABLE}.raw_l_comment_text AS DATE)"),
    ("customer", "measure", "keys", "max", "${TABLE}.c_custkey_no"),
]
_TEXT_VIEWS = [*VIEWS, ("the_rich_ones", None, "SELECT c_custkey FROM customer WHERE c_acctbal_now >= 1")]
_TEXT_EXPLORES = [*EXPLORES[:1], ("lines", "lineitem", "${orders.o_orderdate} IS NOT NULL", EXPLORES[1][3])]


def _brute_coverage() -> str:
    """Containment as the other engine tests it: every need against every text of the model."""
    fields_, views_ = values([tuple(x) for x in _TEXT_FIELDS], ("view", "kind", "name", "type", "sql")), values(_TEXT_VIEWS, ("view", "tbl", "derived"))
    flat = lambda c: f"LOWER(TRIM(REGEXP_REPLACE({c}, '\\s+', ' ', 'g')))"
    f = f"(SELECT kind, LOWER(name) AS name, type, {flat('sql')} AS sql FROM {fields_}) m"
    types = "CASE f WHEN 'SUM' THEN type IN ('sum', 'sum_distinct') WHEN 'COUNT' THEN type IN ('count', 'count_distinct') WHEN 'AVG' THEN type IN ('average', 'average_distinct') WHEN 'MIN' THEN type = 'min' WHEN 'MAX' THEN type = 'max' END"
    parts = "LIST_FILTER(STRING_SPLIT(parts, ','), lambda p: p <> '')"
    all_in = lambda text: f"LIST_BOOL_AND(LIST_TRANSFORM({parts}, lambda p: CONTAINS({text}, p)))"
    loose = [d for d in DIMENSIONS if not any(p[0] == d[0] and p[1] == d[1] and p[5] for p in PREDICATES)]
    is_loose = " OR ".join(f"query_id % {len(TEMPLATES)} = {k} AND col = '{c}'" for k, c in loose)
    always = "COALESCE(CONTAINS('${orders.o_orderdate} is not null', col), false)"
    return (
        "CASE need WHEN 'table' THEN ok WHEN 'join' THEN ok "
        f"WHEN 'measure' THEN EXISTS (SELECT 1 FROM {f} WHERE kind = 'measure' AND {types} AND (col IS NULL OR CONTAINS(sql, col))) "
        f"WHEN 'dimension' THEN EXISTS (SELECT 1 FROM {f} WHERE kind <> 'measure' AND (name = col OR CONTAINS(sql, col)) OR kind = 'measure' AND ({is_loose}) AND CONTAINS(sql, col)) "
        f"WHEN 'case' THEN EXISTS (SELECT 1 FROM {f} WHERE kind = 'dimension' AND (name = col OR CONTAINS(sql, 'case') AND CONTAINS(sql, 'when') AND {all_in('sql')})) "
        f"WHEN 'derived' THEN EXISTS (SELECT 1 FROM (SELECT LOWER(view) AS v, {flat('derived')} AS d FROM {views_} WHERE derived IS NOT NULL) WHERE CONTAINS(v, col) AND (LEN({parts}) = 0 OR {all_in('d')})) "
        f"WHEN 'structural' THEN {always} OR EXISTS (SELECT 1 FROM (SELECT {flat('derived')} AS d FROM {views_} WHERE derived IS NOT NULL) WHERE {all_in('d')}) END"
    )


@query(f'SELECT query_id, need, f AS function, col AS "column", parts, {_brute_coverage()} AS covered FROM (SELECT query_id, need, f, col, LOWER(parts) AS parts, ok FROM ({facts(NEEDS, "need", "f", "col", "parts", "ok")}))')
def model_coverage_by_text(spark, sf):
    model_fields = spark.createDataFrame([tuple(x) for x in _TEXT_FIELDS], "view string, kind string, name string, type string, sql string")
    views = spark.createDataFrame(_TEXT_VIEWS, "view string, table string, derived string")
    explores = spark.createDataFrame(_TEXT_EXPLORES, "explore string, base string, always_where string, joins array<struct<view:string,sql_on:string,relationship:string>>")
    out = containment.check(prints(spark, sf), model_fields, views, explores)
    return out.select("query_id", "need", "function", "column", F.array_join("parts", ",").alias("parts"), "covered")


@query("SELECT DISTINCT n.needle, t.c_custkey AS source FROM (SELECT RIGHT(c_name, 3) AS needle FROM customer UNION SELECT LOWER(LEFT(c_mktsegment, 5)) FROM customer UNION SELECT '7') n JOIN (SELECT c_custkey, c_name || ' ' || LOWER(c_mktsegment) || ' ' || CAST(CAST(FLOOR(ABS(c_acctbal)) AS BIGINT) AS VARCHAR) AS text FROM customer) t ON CONTAINS(t.text, n.needle)")
def contained_names(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    needles = rows.select(F.right("c_name", F.lit(3)).alias("needle")).unionAll(rows.select(F.lower(F.left("c_mktsegment", F.lit(5))))).unionAll(rows.select(F.lit("7")))
    amount = F.floor(F.abs("c_acctbal")).cast("bigint").cast("string")
    texts = rows.select(F.lit("").alias("group"), F.col("c_custkey").alias("source"), F.concat_ws(" ", "c_name", F.lower("c_mktsegment"), amount).alias("text"))
    return containment.contained(needles.select(F.lit("").alias("group"), "needle"), texts).select("needle", "source")


@query(f"SELECT query_id, CASE WHEN BOOL_AND(covered) THEN 'pass' WHEN 2 * COUNT(*) FILTER (WHERE NOT covered) < COUNT(*) THEN 'partial' ELSE 'fail' END AS status FROM ({_NEEDED}) GROUP BY query_id")
def three_way_coverage(spark, sf):
    return coverage.three_way(_checked(spark, sf))


@query(f"SELECT ROUND(100.0 * COUNT(*) FILTER (WHERE ok) / COUNT(*), 2) AS coverage_pct FROM (SELECT query_id, BOOL_AND(covered) AS ok FROM ({_NEEDED}) GROUP BY 1)")
def coverage_share(spark, sf):
    return fields.coverage_share(fields.coverage_by_query(_checked(spark, sf)))


@query(
    f"SELECT CONCAT_WS(' ', need, COALESCE(f, ''), COALESCE(col, '*')) AS gap, CASE WHEN need IN ('measure', 'dimension', 'derived', 'structural') THEN 'prompt_fix' ELSE 'mdm_fix' END AS category, COUNT(*) AS n "
    f"FROM ({_NEEDED}) WHERE NOT covered GROUP BY 1, 2 ORDER BY n DESC, gap LIMIT 10"
)
def open_needs(spark, sf):
    return coverage.open_needs(_checked(spark, sf))


@query(
    f"SELECT query_id, 'block' AS level, 'no condition for join part' AS fault FROM ({facts([(3, 'x')], 'x')}) UNION ALL SELECT query_id, 'block', 'no table for view part' FROM ({facts([(3, 'x')], 'x')}) "
    f"UNION ALL SELECT query_id, 'block', CONCAT_WS(' ', 'no', need, f, col) FROM ({_NEEDED}) WHERE NOT covered AND need IN ('measure', 'structural')"
)
def reconstruction_faults(spark, sf):
    # Fingerprints are dear, and several branches read them.
    f = cut(corpus.good(prints(spark, sf)).select("query_id", "parse_error", "primary_table", *containment.READ))
    fields_, views, explores = model(spark)
    return coverage.reconstruction(coverage.check(coverage.needs(f), fields_, views, explores), f, views, explores)


@query(
    "SELECT view || '_' || c_custkey AS view, kind, CASE WHEN kind = 'view' THEN name || '_' || c_custkey ELSE name END AS name, gap FROM customer CROSS JOIN (VALUES ('orders', 'dim', 'o_orderpriority', 'short_description'), ('orders', 'dim', 'o_orderstatus', 'missing_description'), ('orders', 'dim', 'o_orderstatus', 'missing_label'), ('orders', 'dim', 'o_orderstatus', 'missing_tags'), "
    "('orders', 'measure', 'total_price', 'missing_value_format'), ('lineitem', 'measure', 'least_quantity', 'missing_value_format'), ('orders', 'view', 'orders', 'promote_to_dim_group'), ('final_dt', 'view', 'final_dt', 'missing_primary_key')) t(view, kind, name, gap)"
)
def baseline_gaps(spark, sf):
    return proposals.baseline_gaps(fields_for_customers(spark, sf))


@query(
    f"WITH s AS (SELECT DISTINCT src, alias, col, op, val FROM ({facts([(1, 'orders', 'final', 'o_orderstatus', '=', '{S}'), (1, 'orders', 'final', 'o_orderdate', '=', '1996'), (1, 'customer', 'rich', 'c_acctbal', '>=', '{P}')], 'src', 'alias', 'col', 'op', 'val')})), n AS (SELECT src, COUNT(*) AS n FROM s GROUP BY src) "
    "SELECT src AS \"table\", 'risk' AS kind, 'structural filters must be baked in' AS topic, n FROM n UNION ALL SELECT src, 'risk', 'derived views need structural filters', 2 FROM n UNION ALL SELECT * FROM (VALUES ('orders', 'risk', 'temporary tables may become persistent', 1), ('orders', 'risk', 'dates are plain dimensions', 1), "
    "('orders', 'question', 'persistent or plain derived tables', 1), ('orders', 'question', 'relationship of each join', 1), ('customer', 'question', 'relationship of each join', 1), ('lineitem', 'question', 'relationship of each join', 2), ('part', 'question', 'relationship of each join', 2), "
    "('supplier', 'question', 'relationship of each join', 2), ('lineitem', 'risk', 'no primary key', 1), ('lineitem', 'question', 'which column is the primary key', 1)) t"
)
def review_risks(spark, sf):
    f = prints(spark, sf)
    return proposals.risks(corpus.table_context(f), corpus.structural_filters(f), model(spark)[0])


@query(
    f"WITH q AS (SELECT tbl, COUNT(*) AS n FROM ({_USED}) GROUP BY tbl), o AS (SELECT tbl, col, COUNT(DISTINCT query_id) AS n FROM ({_USED}) JOIN ({facts([p for p in PREDICATES if p[5]], 'col', 'op', 'val', 'neg', 'main')}) USING (query_id) GROUP BY ALL), "
    "f AS (SELECT o.tbl, STRING_AGG(col, ',' ORDER BY col) AS cols FROM o JOIN q USING (tbl) WHERE o.n >= 0.8 * q.n GROUP BY 1) SELECT t.*, COALESCE(cols, '') AS common_filters FROM (VALUES "
    "('orders', 5, 1, 0, true, 'AVG(o_totalprice),COUNT(o_custkey),SUM(o_totalprice)', 'o_orderdate', 'final,rich'), ('customer', 0, 0, 0, false, 'AVG(o_totalprice),COUNT(o_custkey)', 'o_orderdate', 'final,rich'), "
    "('lineitem', 0, 1, 0, false, 'MAX(*),MIN(l_quantity)', 'l_shipdate', ''), ('part', 0, 0, 0, false, 'MAX(*),MIN(l_quantity)', 'l_shipdate', ''), ('supplier', 0, 0, 0, false, 'MAX(*),MIN(l_quantity)', 'l_shipdate', '')) "
    't("table", dimensions, measures, dim_groups, has_key, needed_measures, needed_dim_groups, needed_derived) LEFT JOIN f ON f.tbl = t."table"'
)
def needed_and_existing(spark, sf):
    f = prints(spark, sf)
    out = proposals.needed_and_existing(corpus.table_context(f), f, model(spark)[0])
    return out.select("table", "dimensions", "measures", "dim_groups", "has_key", *[F.array_join(c, ",").alias(c) for c in ("needed_measures", "needed_dim_groups", "needed_derived", "common_filters")])


@query("SELECT view || '_' || c_custkey AS view, origin, n FROM customer CROSS JOIN (VALUES ('orders', 'existing_preserved', 2), ('orders', 'gold_query', 1), ('orders', 'mdm', 1), ('orders', 'inferred', 2), ('final_dt', 'gold_query', 1), ('lineitem', 'inferred', 1)) t(view, origin, n)")
def field_origins(spark, sf):
    rows = fields_for_customers(spark, sf)
    named = lambda *names: reduce(lambda c, n: c | (F.col("name") == n), names, F.lit(False))
    return proposals.origins(rows, rows.where(named("o_orderkey", "o_orderpriority")), rows.where(named("o_orderstatus", "o_custkey")), rows.where(named("ship_date")))


@query(f"WITH u AS (SELECT DISTINCT tbl FROM ({_USED})), m AS (SELECT * FROM {values(_DESCRIBED, ('tbl', 'cov'))}) SELECT u.tbl AS subject, 'warn' AS level, 'few columns are described' AS finding FROM u LEFT JOIN m USING (tbl) WHERE COALESCE(cov, 0) < 0.5 UNION ALL SELECT CAST(query_id AS VARCHAR), 'warn', err FROM ({facts(SUMMARY, 'err', 'cls', 'ready')}) WHERE err IS NOT NULL")
def discovery_gate(spark, sf):
    return proposals.discovery_gate(prints(spark, sf), spark.createDataFrame(_DESCRIBED, "table string, coverage double"))


# --- sources, profiles and gates over the tables and the model above ---------------------------------------------------------------


@query(f"SELECT 'sql' AS \"column\", AVG(CASE WHEN c_custkey % {len(TEMPLATES)} < 5 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25)")
def sql_column_detection(spark, sf):
    return corpus.sql_columns(statements_of_customers(spark, sf).orderBy("query_id").select("prompt", "sql"))


@query("SELECT c_name, ROW_NUMBER() OVER (ORDER BY c_name) AS number FROM customer")
def numbered_rows(spark, sf):
    return numbered(spark.read.parquet(f"{sf}/customer.parquet"), "c_name")


@query("SELECT o_orderpriority || '/' || o_orderstatus || k.suffix AS path, k.kind FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders) JOIN (VALUES ('.view.lkml', 'view'), ('.model.lkml', 'model'), ('.explore.lkml', 'explore'), ('.dashboard.lookml', 'dashboard'), ('.lkml', 'lookml'), ('.sql', NULL)) k(suffix, kind) ON true")
def file_kinds(spark, sf):
    names = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("name")).distinct()
    suffixes = F.array(*map(F.lit, (".view.lkml", ".model.lkml", ".explore.lkml", ".dashboard.lookml", ".lkml", ".sql")))
    paths = names.select("name", F.explode(suffixes).alias("suffix")).select(F.concat("name", "suffix").alias("path"))
    return paths.select("path", model_file_kind(F.col("path")).alias("kind"))


@query("SELECT n_name AS \"table\", 'views/' || n_name || '.view.lkml' AS path FROM nation UNION ALL SELECT r_name, 'old/bq_' || r_name || '.view.lkml' FROM region")
def baseline_files(spark, sf):
    nations, regions = (spark.read.parquet(f"{sf}/{t}.parquet").select(F.col(c).alias("table")) for t, c in (("nation", "n_name"), ("region", "r_name")))
    path = lambda head, t=F.col("table"): F.concat(F.lit(head), t, F.lit(".view.lkml")).alias("path")
    files = nations.select(path("views/")).unionByName(nations.select(path("old/dw_"))).unionByName(regions.select(path("old/bq_"))).withColumn("head", F.lit(""))
    return resolve_baselines(nations.unionByName(regions), files)


@query("SELECT name, CASE WHEN type = 'time' THEN 'dimension_group' WHEN type IN ('sum', 'min') OR type = 'number' THEN 'measure' ELSE 'dimension' END AS kind FROM " + values_for_customers([(f[2], f[3]) for f in FIELDS], ("name", "type"), "name"))
def field_kinds(spark, sf):
    return for_customers(spark, sf, FIELDS, _FIELD_TYPES, "name").select("name", fields.field_kind(F.col("type")).alias("kind"))


@query(
    "SELECT view || '_' || c_custkey AS view, status, blocking, warnings FROM customer CROSS JOIN (VALUES ('orders', 'fail', 'fields without description', 'descriptions of unusual length'), ('final_dt', 'fail', 'no primary key', 'no measures'), ('lineitem', 'fail', 'no primary key', '')) t(view, status, blocking, warnings)"
)
def enrichment_gate(spark, sf):
    return fields.enrichment_gate(fields_for_customers(spark, sf))


@query("SELECT c_custkey, 2.0 / 3 AS share FROM customer")
def changed_lines(spark, sf):
    texts = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.concat_ws("\n", "c_name", F.lit("same"), F.lit("old")).alias("a"), F.concat_ws("\n", "c_name", F.lit("new"), F.lit("same")).alias("b"))
    return texts.select("c_custkey", fields.changed_share(F.col("a"), F.col("b")).alias("share"))


@query("SELECT 'c' || c_custkey AS \"table\" FROM customer WHERE c_custkey % 10 < 3 AND c_custkey // 10 * 10 >= 10 AND c_custkey // 10 * 10 + 2 <= (SELECT MAX(c_custkey) FROM customer)")
def dependency_cycles(spark, sf):
    """In every ten numbers three that need each other in a ring, and seven in a chain that leads into it."""
    n = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("n")).where("n >= 10")
    at = F.col("n") % 10
    needs = F.when(at < 2, F.col("n") + 1).when(at == 2, F.col("n") - 2).when(at == 3, F.col("n") - 3).otherwise(F.col("n") - 1)
    return fields.cycles(n.select(F.concat(F.lit("c"), "n").alias("table"), F.concat(F.lit("c"), needs).alias("needs")))


# --- statements of a dialect's odder forms, and broken ones -------------------------------------------------------------------------

DIALECT = (
    "WITH a (p, q) AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = '{S}'), b AS (SELECT p FROM a) SELECT COUNT(DISTINCT p, q) pairs, SUM(q) / 2 half, MAX(p) FROM b "
    "JOIN LATERAL (SELECT 1 FROM part) x ON TRUE WHERE NOT (p > {P} AND NOT q = 1) AND r BETWEEN DATE '1996-01-01' AND DATE('1996-12-31') AND s BETWEEN -1 AND {P}",
    "SELECT SUM(x) AS n FROM t WHERE ((a = 1)",
    "SELECT x FROM t WHERE a = '{S}",
    "SELECT CASE WHEN a = 1 THEN '{S}' FROM t",
    "SELECT FROM t WHERE a = {P}",
    "SELECT a FROM t WHERE GROUP BY a",
)
_D_PREDICATES = [(0, "o_orderstatus", "=", "'{S}'", False), (0, "p", ">", "{P}", True), (0, "q", "=", "1", False), (0, "r", "BETWEEN", "DATE '1996-01-01' AND DATE ( '1996-12-31' )", False), (0, "s", "BETWEEN", "-1 AND {P}", False)]
_D_ERRORS = [(0, None, "orders,part"), (1, "unbalanced_brackets", "t"), (2, "unclosed_literal", "t"), (3, "unclosed_case", "t"), (4, "nothing_selected", "t"), (5, "empty_clause", "t")]


def dialect_prints(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.fingerprints(_from_templates(spark, sf, DIALECT))


def _dialect_facts(rows: list[tuple], *columns: str) -> str:
    return facts(rows, *columns).replace(f"c_custkey % {len(TEMPLATES)} = k", f"c_custkey % {len(DIALECT)} = k")


@query(f'SELECT query_id, col AS "column", op AS operator, val AS value, neg AS negated FROM ({_dialect_facts(_D_PREDICATES, "col", "op", "val", "neg")})')
def dialect_predicates(spark, sf):
    return corpus.good(dialect_prints(spark, sf)).select("query_id", F.explode("predicates").alias("p")).select("query_id", "p.column", "p.operator", "p.value", "p.negated")


@query(f'SELECT query_id, f AS function, col AS "column", dist AS "distinct", alias FROM ({_dialect_facts([(0, "COUNT", "p", True, "pairs"), (0, "SUM", "q", False, "half"), (0, "MAX", "p", False, None)], "f", "col", "dist", "alias")})')
def dialect_aggregations(spark, sf):
    return corpus.good(dialect_prints(spark, sf)).select("query_id", F.explode("aggregations").alias("a")).select("query_id", "a.*")


@query(f'SELECT query_id, err AS parse_error, tables FROM ({_dialect_facts(_D_ERRORS, "err", "tables")})')
def dialect_errors(spark, sf):
    return dialect_prints(spark, sf).select("query_id", "parse_error", F.array_join("tables", ",").alias("tables"))


@query(f"SELECT query_id, 'inner' AS kind, CAST(NULL AS VARCHAR) AS \"table\" FROM ({_dialect_facts([(0, 'x')], 'x')})")
def dialect_joins(spark, sf):
    return corpus.good(dialect_prints(spark, sf)).select("query_id", F.explode("joins").alias("j")).select("query_id", "j.kind", "j.table")


GATED = (
    "SELECT a.x FROM a JOIN b ON a.x = b.x JOIN c ON b.y = c.y JOIN b ON d.z = b.z WHERE a.x > {P}",
    "WITH lone AS (SELECT '{S}' AS one), next AS (SELECT one FROM lone) SELECT one FROM next",
    "WITH bare AS () SELECT x FROM a",
    "WITH far AS (SELECT x FROM unheard_of) SELECT far.x FROM far JOIN a ON far.x = a.x JOIN b ON a.x = b.x",
    "SELECT a.x FROM a WHERE a.x = (1",
)


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS subject, level, finding FROM customer JOIN (VALUES (0, 'block', 'joins come back to b'), (1, 'warn', 'nothing is read by CTE lone'), (2, 'block', 'no body of CTE bare'), (4, 'warn', 'unbalanced_brackets')) t(k, level, finding) ON c_custkey % 5 = k "
    "UNION ALL SELECT * FROM (VALUES ('unheard_of', 'block', 'not known, but read by CTE far'), ('unheard_of', 'warn', 'few columns are described'), ('b', 'warn', 'few columns are described')) u"
)
def discovery_faults(spark, sf):
    found = corpus.fingerprints(_from_templates(spark, sf, GATED))
    described = spark.createDataFrame([("a", 0.5), ("b", 0.49), ("c", 1.0)], "table string, coverage double")
    return proposals.discovery_gate(found, described, known=described)


# --- texts that aren't one query, and what mends them --------------------------------------------------------------------------------

#: text, its fault, the steps taken (joined by |), the text after them, and what is still wrong.
REPAIRS = (
    ("SELECT a FROM t WHERE s = '{S}; ' -- kept; whole", None, "", "SELECT a FROM t WHERE s = '{S}; ' -- kept; whole", None),
    ("SELECT a FROM t WHERE s = '{S}' ; ;\n", "trailing_semicolon", "trim_trailing_semicolons", "SELECT a FROM t WHERE s = '{S}'", None),
    ("SELECT a FROM t WHERE s = ‘{S}’\u00a0AND b > {P};", "foreign_characters", "trim_trailing_semicolons|normalize_smart_quotes", "SELECT a FROM t WHERE s = '{S}' AND b > {P}", None),
    ("SET x = ';'; -- first\nSELECT a FROM t WHERE b = {P}; SELECT 2", "not_a_query", "first_statement", "-- first\nSELECT a FROM t WHERE b = {P}", None),
    ("SELECT a FROM t WHERE b = {P}; SELECT 2;", "several_statements", "trim_trailing_semicolons|first_statement", "SELECT a FROM t WHERE b = {P}", None),
    ("DECLARE d DATE DEFAULT '{S}'\nSELECT a FROM t", "not_a_query", "strip_bq_scripting", "SELECT a FROM t", None),
    ("BEGIN SELECT “a” FROM t; END", "not_a_query", "normalize_smart_quotes|strip_bq_scripting", 'SELECT "a" FROM t; END', "several_statements"),
    ("SELECT a FROM t WHERE b = {P} SELECT c FROM u", "clause_order", "", "SELECT a FROM t WHERE b = {P} SELECT c FROM u", "clause_order"),
    ("SELECT a, FROM WHERE ((", "empty_clause", "", "SELECT a, FROM WHERE ((", "empty_clause"),
    ("sums of {S}", "not_a_query", "", "sums of {S}", "not_a_query"),
    ("SELECT EXTRACT(YEAR FROM d), ARRAY_AGG(x ORDER BY y LIMIT 1), t.* EXCEPT (q) FROM t JOIN u ON a = b WHERE CASE WHEN a IS DISTINCT FROM b THEN {P} END > 1 ORDER BY 1;", "trailing_semicolon", "trim_trailing_semicolons", "SELECT EXTRACT(YEAR FROM d), ARRAY_AGG(x ORDER BY y LIMIT 1), t.* EXCEPT (q) FROM t JOIN u ON a = b WHERE CASE WHEN a IS DISTINCT FROM b THEN {P} END > 1 ORDER BY 1", None),
    (" \"\" ;", "empty_input", "", " \"\" ;", "empty_input"),
)
_R_FACTS = facts([(k, *r[1:]) for k, r in enumerate(REPAIRS)], "fault", "steps", "repaired", "remaining").replace(f"c_custkey % {len(TEMPLATES)} = k", f"c_custkey % {len(REPAIRS)} = k")


@query(_R_FACTS)
def sql_repairs(spark, sf):
    found = repair.repaired(_from_templates(spark, sf, tuple(r[0] for r in REPAIRS)))
    return found.select("query_id", "fault", F.array_join("steps", "|").alias("steps"), "repaired", "remaining")


@query(f"SELECT fault, REPLACE(steps, '|', ' > ') AS steps, remaining, COUNT(*) AS queries FROM ({_R_FACTS}) GROUP BY ALL")
def sql_repair_counts(spark, sf):
    return repair.repair_counts(repair.repaired(_from_templates(spark, sf, tuple(r[0] for r in REPAIRS))))


# --- validation of texts ----------------------------------------------------------------------------------------------------------------

_V_TEMPLATES = (
    "SELECT a, ROW_NUMBER() OVER (PARTITION BY b ORDER BY a) AS n FROM zeta_{S}",
    "SELECT CASE WHEN a > {P} THEN 'x' ELSE 'y' END AS c, SUM(b) AS s FROM t_{S}",
    "SELECT z.a, COUNT(*) AS n FROM z_{S} z JOIN b_{S} b ON z.a = b.a",
    "SELECT SUM(a) AS s, MIN(a) AS m FROM t_{S}",
    "WITH c AS (SELECT a FROM t_{S}) SELECT a FROM c",
    "SELECT a FROM x_{S} x JOIN y_{S} y ON x.a = y.a LEFT JOIN b_{S} b ON y.a = b.a",
    "SELECT a FROM",
)
#: Fixed values by template: parses, tables, joins, aggregates, CTE, window, class.
_V_FACTS = [
    (0, True, "zeta_{S}", 0, 0, False, True, "complex"),
    (1, True, "t_{S}", 0, 1, False, False, "simple"),
    (2, True, "b_{S},z_{S}", 1, 1, False, False, "medium"),
    (3, True, "t_{S}", 0, 2, False, False, "medium"),
    (4, True, "t_{S}", 0, 0, True, False, "complex"),
    (5, True, "b_{S},x_{S},y_{S}", 2, 0, False, False, "complex"),
    (6, False, None, None, None, None, None, None),
]


@query(
    f"SELECT c_custkey AS query_id, parses, REPLACE(tbls, '{{S}}', c_mktsegment) AS \"tables\", CAST(j AS INT) AS join_count, CAST(a AS INT) AS agg_count, CAST(c AS BOOLEAN) AS has_cte, CAST(w AS BOOLEAN) AS has_window, cls AS complexity FROM customer JOIN {values(_V_FACTS, ('k', 'parses', 'tbls', 'j', 'a', 'c', 'w', 'cls'))} ON c_custkey % {len(_V_TEMPLATES)} = k"
)
def sql_validation(spark, sf):
    out = corpus.validator(corpus.fingerprints(_from_templates(spark, sf, _V_TEMPLATES)))
    return out.withColumn("tables", F.array_join("tables", ","))


# --- sheets: their sizes, and rows by number -----------------------------------------------------------------------------------------


@query("SELECT 'customer' AS sheet, COUNT(*) AS \"rows\", CAST((SELECT COUNT(*) FROM (DESCRIBE customer)) AS INT) AS columns FROM customer UNION ALL SELECT 'orders', COUNT(*), CAST((SELECT COUNT(*) FROM (DESCRIBE orders)) AS INT) FROM orders")
def sheet_listing(spark, sf):
    return sheet_sizes({t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders")})


@query("SELECT number, c_custkey, c_name FROM (SELECT ROW_NUMBER() OVER (ORDER BY c_name) AS number, c_custkey, c_name FROM customer) WHERE number BETWEEN 21 AND 1020")
def sheet_row_range(spark, sf):
    return row_range(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name"), "c_name", 21, 5000)


@query("SELECT ROW_NUMBER() OVER (ORDER BY o_orderkey) AS number, o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50")
def sheet_preview(spark, sf):
    return preview(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus"), "o_orderkey", 60)
