"""Registered queries over the driver's tables, each with the SQL that an independent engine runs for comparison."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatica import corpus_queries, freshness_queries, gate_queries, model_queries, samples, vocabulary_queries  # noqa: F401  modules that register their queries
from prismatica.functions import naming, sqltext
from prismatica.functions.timeframes import TIMEFRAMES, in_year
from prismatica.operators import corpus, fields, profile, proposals
from prismatica.plans.explore import build
from prismatica.plans.model import Dimension, Explore, Join, Measure, Model, Request, View
from prismatica.registry import ORACLE, QUERIES, query
from prismatica.sources.corpus import metadata_coverage

def _reader(spark: SparkSession, sf: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- one semantic model over the tables -------------------------------------------------------------------------------------------


def _balances(tables):
    """Customers with a scope column, as a derived table with a structural filter."""
    return tables("customer").where("c_acctbal > -500").select("c_custkey", "c_acctbal", F.lit("retail").alias("scope"))


def _final_orders(tables):
    return tables("orders").where("o_orderstatus in ('F', 'O')").withColumn("scope", F.lit("retail"))


MODEL = Model(
    views={
        "orders": View(
            "orders",
            "orders",
            primary_key="o_orderkey",
            dimensions=(
                Dimension("o_orderpriority", "${TABLE}.o_orderpriority", order_by="priority_rank"),
                Dimension("priority_rank", "CASE trim(${o_orderpriority}) WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END", "number", hidden=True),
                Dimension("o_orderstatus", "${TABLE}.o_orderstatus"),
                Dimension("o_totalprice", "${TABLE}.o_totalprice", "number"),
                Dimension("band", "CASE WHEN ${o_totalprice} >= 300000 THEN 'large' WHEN ${o_totalprice} >= 100000 THEN 'medium' ELSE 'small' END"),
            ),
            times={"ordered": "${TABLE}.o_orderdate"},
            measures=(
                Measure("total_price", "sum", "${o_totalprice}"),
                Measure("n_orders", "count"),
                Measure("unique_customers", "count_distinct", "${TABLE}.o_custkey"),
                Measure("avg_price", "average", "${o_totalprice}"),
                Measure("min_price", "min", "${o_totalprice}"),
                Measure("max_price", "max", "${o_totalprice}"),
                Measure("stddev_price", "stddev", "${o_totalprice}"),
                Measure("variance_price", "variance", "${o_totalprice}"),
                Measure("median_price", "median", "${o_totalprice}"),
                Measure("final_price", "sum", "${o_totalprice}", {"o_orderstatus": "F"}),
                Measure("price_millions", "number", "round(${total_price} / 1e6, 2)"),
                Measure("distinct_price", "sum_distinct", "${o_totalprice}", key="${TABLE}.o_orderkey"),
                Measure("distinct_avg_price", "average_distinct", "${o_totalprice}", key="${TABLE}.o_orderkey"),
            ),
        ),
        "customer": View("customer", "customer", primary_key="c_custkey", dimensions=(Dimension("c_mktsegment", "${TABLE}.c_mktsegment"),), measures=(Measure("avg_balance", "average", "${TABLE}.c_acctbal"),)),
        "nation": View("nation", "nation", primary_key="n_nationkey", dimensions=(Dimension("n_name", "${TABLE}.n_name"),)),
        "region": View("region", "region", primary_key="r_regionkey", dimensions=(Dimension("r_name", "${TABLE}.r_name"),)),
        "supplier": View("supplier", "supplier", primary_key="s_suppkey", dimensions=(Dimension("s_name", "${TABLE}.s_name"),)),
        "lineitem": View(
            "lineitem",
            "lineitem",
            dimensions=(Dimension("l_returnflag", "${TABLE}.l_returnflag"), Dimension("l_linestatus", "${TABLE}.l_linestatus"), Dimension("l_quantity", "${TABLE}.l_quantity", "number")),
            times={"shipped": "${TABLE}.l_shipdate"},
            measures=(Measure("revenue", "sum", "${TABLE}.l_extendedprice"), Measure("lines", "count"), Measure("avg_quantity", "average", "${l_quantity}"), Measure("revenue_millions", "number", "round(${revenue} / 1e6, 2)")),
        ),
        "final_orders": View(
            "final_orders",
            derived=_final_orders,
            dimensions=(
                Dimension("o_orderstatus", "${TABLE}.o_orderstatus"),
                Dimension("urgency", "CASE WHEN trim(${TABLE}.o_orderpriority) IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN trim(${TABLE}.o_orderpriority) = '3-MEDIUM' THEN 'usual' ELSE 'slow' END"),
                Dimension("balance_band", "CASE WHEN ${balances.c_acctbal} >= 7500 THEN 'top' WHEN ${balances.c_acctbal} >= 2500 THEN 'middle' ELSE 'low or unknown' END"),
            ),
            measures=(Measure("total_price", "sum", "${TABLE}.o_totalprice"), Measure("n_orders", "count"), Measure("total_balance", "sum", "${balances.c_acctbal}")),
        ),
        "balances": View("balances", derived=_balances, dimensions=(Dimension("c_acctbal", "${TABLE}.c_acctbal", "number"),)),
    },
    explores={
        "orders": Explore("orders", "orders"),
        "final": Explore("final", "orders", always_where="${o_orderstatus} = 'F'"),
        "recent": Explore("recent", "orders", always_filter={"orders.ordered_date": "last 12 months"}),
        "customers": Explore("customers", "customer"),
        "lines": Explore("lines", "lineitem"),
        "order_lines": Explore("order_lines", "orders", (Join("lineitem", (("orders.o_orderkey", "l_orderkey"),), "inner", "one_to_many"),)),
        "order_regions": Explore(
            "order_regions",
            "orders",
            (
                Join("lineitem", (("orders.o_orderkey", "l_orderkey"),), "inner", "one_to_many"),
                Join("customer", (("orders.o_custkey", "c_custkey"),)),
                Join("nation", (("customer.c_nationkey", "n_nationkey"),)),
                Join("region", (("nation.n_regionkey", "r_regionkey"),)),
            ),
        ),
        "line_suppliers": Explore(
            "line_suppliers",
            "lineitem",
            (Join("supplier", (("lineitem.l_suppkey", "s_suppkey"),), "inner"), Join("nation", (("supplier.s_nationkey", "n_nationkey"),), "inner"), Join("region", (("nation.n_regionkey", "r_regionkey"),), "inner")),
            always_where="lower(region.r_name) IN ('asia', 'europe')",
        ),
        "final_balances": Explore("final_balances", "final_orders", (Join("balances", (("final_orders.o_custkey", "c_custkey"), ("final_orders.scope", "scope"))),)),
    },
)


def ask(spark: SparkSession, sf: str, *args, as_of: dt.datetime | None = None, **kwargs) -> DataFrame:
    return build(_reader(spark, sf), MODEL, Request(*args, **kwargs), as_of)


# --- the ten analogues of the analytical corpus -----------------------------------------------------------------------------------


@query("SELECT ROUND(SUM(l_extendedprice), 2) AS revenue FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'")
def q01_filtered_sum(spark, sf):
    return _rounded(ask(spark, sf, "lines", measures=("lineitem.revenue",), filters={"lineitem.l_returnflag": "R", "lineitem.l_linestatus": "F", "lineitem.shipped_date": "1996"}))


@query("SELECT ROUND(SUM(o_totalprice), 2) AS total_price FROM orders WHERE EXTRACT(YEAR FROM o_orderdate) = 1996 AND o_orderstatus = 'F'")
def q02_year_sum(spark, sf):
    return _rounded(ask(spark, sf, "orders", measures=("orders.total_price",), filters={"orders.ordered_year": "1996", "orders.o_orderstatus": "F"}))


@query("SELECT c_mktsegment, ROUND(AVG(c_acctbal), 2) AS avg_balance FROM customer GROUP BY c_mktsegment")
def q03_group_avg(spark, sf):
    return _rounded(ask(spark, sf, "customers", ("customer.c_mktsegment",), ("customer.avg_balance",)))


@query("SELECT l_returnflag, ROUND(SUM(l_extendedprice) / 1e6, 2) AS revenue_millions FROM lineitem WHERE EXTRACT(YEAR FROM l_shipdate) = 1997 GROUP BY l_returnflag")
def q04_ratio_round(spark, sf):
    return ask(spark, sf, "lines", ("lineitem.l_returnflag",), ("lineitem.revenue_millions",), {"lineitem.shipped_year": "1997"})


@query("SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS total_price FROM orders WHERE o_totalprice > 0 AND o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY total_price DESC")
def q05_order_desc(spark, sf):
    return _rounded(ask(spark, sf, "final", ("orders.o_orderpriority",), ("orders.total_price",), {"orders.o_totalprice": ">0"})).orderBy(F.desc("total_price"))


@query("SELECT CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS order_month, ROUND(SUM(o_totalprice), 2) AS total_price FROM orders WHERE EXTRACT(YEAR FROM o_orderdate) = 1997 GROUP BY order_month")
def q06_month_rollup(spark, sf):
    orders = _reader(spark, sf)("orders").where(in_year(F.col("o_orderdate"), 1997))
    return orders.groupBy(F.month("o_orderdate").cast("bigint").alias("order_month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total_price"))


@query("SELECT o_orderstatus, ROUND(SUM(o_totalprice), 2) AS total_price FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus")
def q07_in_list(spark, sf):
    return _rounded(ask(spark, sf, "orders", ("orders.o_orderstatus",), ("orders.total_price",), {"orders.o_orderstatus": "F, O"}))


@query(
    "SELECT COUNT(DISTINCT c.c_custkey) AS customers FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30' "
    "WHERE c.c_custkey IS NOT NULL AND o.o_orderkey IS NULL AND c.c_mktsegment = 'BUILDING'"
)
def q08_count_distinct(spark, sf):
    t = _reader(spark, sf)
    half = t("orders").where(F.col("o_orderdate").between(F.lit(dt.datetime(1996, 1, 1)).cast("timestamp_ntz"), F.lit(dt.datetime(1996, 6, 30)).cast("timestamp_ntz")))
    customers = t("customer").where("c_custkey is not null and c_mktsegment = 'BUILDING'")
    return customers.join(half, F.col("c_custkey") == F.col("o_custkey"), "left").where("o_orderkey is null").agg(F.countDistinct("c_custkey").alias("customers"))


@query(
    "WITH o AS (SELECT *, 'retail' AS scope FROM orders WHERE o_orderstatus IN ('F', 'O')), b AS (SELECT c_custkey, c_acctbal, 'retail' AS scope FROM customer WHERE c_acctbal > -500) "
    "SELECT o.o_orderstatus, CASE WHEN TRIM(o.o_orderpriority) IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN TRIM(o.o_orderpriority) = '3-MEDIUM' THEN 'usual' ELSE 'slow' END AS urgency, "
    "CASE WHEN b.c_acctbal >= 7500 THEN 'top' WHEN b.c_acctbal >= 2500 THEN 'middle' ELSE 'low or unknown' END AS balance_band, ROUND(SUM(o.o_totalprice), 2) AS total_price, COUNT(*) AS n_orders, "
    "ROUND(SUM(b.c_acctbal), 2) AS total_balance FROM o LEFT JOIN b ON o.o_custkey = b.c_custkey AND o.scope = b.scope GROUP BY 1, 2, 3"
)
def q09_banded_left_join(spark, sf):
    names = ("o_orderstatus", "urgency", "balance_band")
    return _rounded(ask(spark, sf, "final_balances", tuple(f"final_orders.{n}" for n in names), ("final_orders.total_price", "final_orders.n_orders", "final_orders.total_balance")))


@query(
    "WITH n AS (SELECT n_nationkey, n_regionkey FROM nation), r AS (SELECT r_regionkey, r_name FROM region WHERE LOWER(r_name) IN ('asia', 'europe')) SELECT r.r_name, ROUND(SUM(l.l_extendedprice), 2) AS revenue "
    "FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN n ON s.s_nationkey = n.n_nationkey JOIN r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"
)
def q10_three_hop(spark, sf):
    return _rounded(ask(spark, sf, "line_suppliers", ("region.r_name",), ("lineitem.revenue",)))


# --- predicates, joins, sets ------------------------------------------------------------------------------------------------------

_PREDICATES = {
    "pred_neq": ("part", "p_size <> 10"),
    "pred_not": ("orders", "NOT (o_orderstatus IN ('F', 'P'))"),
    "pred_or": ("part", "(p_size < 5 OR p_size >= 45) AND p_retailprice > 1000"),
    "pred_like": ("part", "p_type LIKE '%A%'"),
    "pred_between": ("part", "p_size BETWEEN 10 AND 20"),
    "pred_function": ("orders", "LOWER(TRIM(o_orderstatus)) = 'f'"),
}
for _name, (_table, _text) in _PREDICATES.items():
    query(f"SELECT COUNT(*) AS n FROM {_table} WHERE {_text}", _name)(lambda spark, sf, t=_table, p=_text: _reader(spark, sf)(t).where(p).agg(F.count("*").alias("n")))


def _join(name: str, how: str, sql: str, left: str, right: str, on: str, columns: list[str]):
    def run(spark, sf):
        t = _reader(spark, sf)
        return t(left).join(t(right), F.expr(on) if on else None, how).select(*columns)

    query(sql, name)(run)


_join("join_right", "right", "SELECT n_name, r_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 9", "nation", "region", "n_regionkey = r_regionkey and n_nationkey < 9", ["n_name", "r_name"])
_join("join_full", "full", "SELECT n_nationkey, s_suppkey FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000", "nation", "supplier", "n_nationkey = s_nationkey and s_acctbal > 5000", ["n_nationkey", "s_suppkey"])
_join("join_cross", "cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", "nation", "region", "", ["n_name", "r_name"])
_join("join_semi", "left_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer", "orders", "c_custkey = o_custkey and o_totalprice > 300000", ["c_custkey"])
_join("join_anti", "left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer", "orders", "c_custkey = o_custkey and o_totalprice > 300000", ["c_custkey"])


def _sets(name: str, sql: str, combine):
    def run(spark, sf):
        t = _reader(spark, sf)
        return combine(t("customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 97).alias("m")), t("supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 97).alias("m")))

    pair = ("SELECT c_nationkey AS k, c_custkey % 97 AS m FROM customer", "SELECT s_nationkey AS k, s_suppkey % 97 AS m FROM supplier")
    query(sql.format(*pair), name)(run)


_sets("distinct_union", "{0} UNION {1}", lambda a, b: a.union(b).distinct())
_sets("set_diff", "{0} EXCEPT {1}", lambda a, b: a.subtract(b))
_sets("set_intersect", "{0} INTERSECT {1}", lambda a, b: a.intersect(b))
_sets("symmetric_diff", "({0} EXCEPT {1}) UNION ({1} EXCEPT {0})", lambda a, b: a.subtract(b).union(b.subtract(a)))

# --- timeframes and measures ------------------------------------------------------------------------------------------------------

_FRAMES = {
    "raw": "o_orderdate",
    "date": "CAST(o_orderdate AS DATE)",
    "day_of_week": "CAST(EXTRACT(DOW FROM o_orderdate) + 1 AS BIGINT)",
    "week": "CAST(DATE_TRUNC('week', o_orderdate) AS DATE)",
    "month": "CAST(DATE_TRUNC('month', o_orderdate) AS DATE)",
    "month_name": "STRFTIME(o_orderdate, '%B')",
    "quarter": "CAST(DATE_TRUNC('quarter', o_orderdate) AS DATE)",
    "year": "CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT)",
}
for _frame in TIMEFRAMES:
    query(f"SELECT {_FRAMES[_frame]} AS ordered, COUNT(*) AS n_orders FROM orders GROUP BY 1", f"tf_{_frame}")(
        lambda spark, sf, f=_frame: ask(spark, sf, "orders", (f"orders.ordered_{f}",), ("orders.n_orders",)).withColumnRenamed(f"ordered_{f}", "ordered")
    )

_MEASURES = {
    "count": ("n_orders", "COUNT(*)"),
    "count_distinct": ("unique_customers", "COUNT(DISTINCT o_custkey)"),
    "min": ("min_price", "ROUND(MIN(o_totalprice), 2)"),
    "max": ("max_price", "ROUND(MAX(o_totalprice), 2)"),
    "average": ("avg_price", "ROUND(AVG(o_totalprice), 2)"),
    "stddev": ("stddev_price", "ROUND(STDDEV_SAMP(o_totalprice), 2)"),
    "variance": ("variance_price", "ROUND(VAR_SAMP(o_totalprice), 0)"),
    "median": ("median_price", "ROUND(MEDIAN(o_totalprice), 2)"),
    "filtered": ("final_price", "ROUND(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2)"),
    "number": ("price_millions", "ROUND(SUM(o_totalprice) / 1e6, 2)"),
}
for _kind, (_measure, _sql) in _MEASURES.items():
    query(f"SELECT o_orderpriority, {_sql} AS {_measure} FROM orders GROUP BY o_orderpriority", f"measure_{_kind}")(
        lambda spark, sf, m=_measure, d=0 if _kind == "variance" else 2: _rounded(ask(spark, sf, "orders", ("orders.o_orderpriority",), (f"orders.{m}",)), d)
    )
for _kind, _agg in (("sum", "SUM"), ("average", "AVG")):
    _measure = {"sum": "distinct_price", "average": "distinct_avg_price"}[_kind]
    query(
        f"SELECT l_returnflag, ROUND({_agg}(o_totalprice), 2) AS {_measure} FROM (SELECT DISTINCT l_returnflag, o_orderkey, o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY l_returnflag",
        f"measure_{_kind}_distinct",
    )(lambda spark, sf, m=_measure: _rounded(ask(spark, sf, "order_lines", ("lineitem.l_returnflag",), (f"orders.{m}",))))


@query(
    "SELECT r_name, ROUND(SUM(o_totalprice), 2) AS total_price, COUNT(*) AS n_orders, ROUND(SUM(revenue), 2) AS revenue FROM (SELECT r_name, o_orderkey, MIN(o_totalprice) AS o_totalprice, SUM(l_extendedprice) AS revenue FROM orders "
    "JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, o_orderkey) GROUP BY r_name"
)
def fanout_safe_sum(spark, sf):
    return _rounded(ask(spark, sf, "order_regions", ("region.r_name",), ("orders.total_price", "orders.n_orders", "lineitem.revenue")))


@query("SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def always_where(spark, sf):
    return ask(spark, sf, "final", ("orders.o_orderstatus",), ("orders.n_orders",))


def _last_day(spark, sf) -> dt.datetime:
    return _reader(spark, sf)("orders").agg(F.max("o_orderdate")).first()[0]


_AS_OF = "(SELECT CAST(MAX(o_orderdate) AS DATE) + 1 AS d FROM orders)"


@query(f"SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders, {_AS_OF} WHERE o_orderdate >= d - INTERVAL 12 MONTH AND o_orderdate < d GROUP BY o_orderstatus")
def always_filter_default(spark, sf):
    return ask(spark, sf, "recent", ("orders.o_orderstatus",), ("orders.n_orders",), as_of=_last_day(spark, sf))


@query("SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders WHERE EXTRACT(YEAR FROM o_orderdate) = 1998 GROUP BY o_orderstatus")
def always_filter_override(spark, sf):
    return ask(spark, sf, "recent", ("orders.o_orderstatus",), ("orders.n_orders",), {"orders.ordered_date": "1998"}, as_of=_last_day(spark, sf))


_FILTERS = {
    "eq": ({"orders.o_orderpriority": "1-URGENT"}, "o_orderpriority = '1-URGENT'"),
    "gt": ({"orders.o_totalprice": ">250000"}, "o_totalprice > 250000"),
    "range": ({"orders.o_totalprice": "[1000, 50000]"}, "o_totalprice BETWEEN 1000 AND 50000"),
    "not": ({"orders.o_orderstatus": "-P"}, "o_orderstatus <> 'P'"),
    "wildcard": ({"orders.o_orderpriority": "%HIGH, 5%"}, "(o_orderpriority LIKE '%HIGH' OR o_orderpriority LIKE '5%')"),
    "year": ({"orders.ordered_date": "1999"}, "EXTRACT(YEAR FROM o_orderdate) = 1999"),
    "day": ({"orders.ordered_date": "1996-05-01"}, "CAST(o_orderdate AS DATE) = DATE '1996-05-01'"),
    "last_n_months": ({"orders.ordered_date": "last 3 months"}, "o_orderdate >= d - INTERVAL 3 MONTH AND o_orderdate < d"),
    "last_n_days": ({"orders.ordered_date": "last 90 days"}, "o_orderdate >= d - INTERVAL 90 DAY AND o_orderdate < d"),
    "last_quarter": ({"orders.ordered_date": "last quarter"}, "o_orderdate >= DATE_TRUNC('quarter', d - INTERVAL 1 DAY) - INTERVAL 3 MONTH AND o_orderdate < DATE_TRUNC('quarter', d - INTERVAL 1 DAY)"),
}
for _kind, (_given, _sql) in _FILTERS.items():
    query(f"SELECT COUNT(*) AS n_orders FROM orders, {_AS_OF} WHERE {_sql}", f"filter_expr_{_kind}")(lambda spark, sf, g=_given: ask(spark, sf, "orders", measures=("orders.n_orders",), filters=g, as_of=_last_day(spark, sf)))


@query("SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders GROUP BY o_orderpriority ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END")
def order_by_field(spark, sf):
    return ask(spark, sf, "orders", ("orders.o_orderpriority",), ("orders.n_orders",), order=("o_orderpriority",))


@query("SELECT band, COUNT(*) AS n_orders FROM (SELECT CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS band FROM orders) GROUP BY band ORDER BY n_orders DESC LIMIT 2")
def top_bands(spark, sf):
    return ask(spark, sf, "orders", ("orders.band",), ("orders.n_orders",), order=("n_orders desc",), limit=2)


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT CONCAT(CAST(l_orderkey AS VARCHAR), '|', CAST(l_linenumber AS VARCHAR), '|', CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS n_keys FROM lineitem")
def synthetic_pk(spark, sf):
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("|"), F.col("l_linenumber").cast("string"), F.lit("|"), F.to_date("l_shipdate").cast("string"))
    return _reader(spark, sf)("lineitem").agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"))


@query("SELECT CAST(SUM(p_partkey) AS BIGINT) AS total_p_partkey, CAST(SUM(p_size) AS BIGINT) AS total_p_size, ROUND(SUM(p_retailprice), 2) AS total_p_retailprice FROM part")
def default_measures(spark, sf):
    part = _reader(spark, sf)("part")
    numbers = [f.name for f in part.schema if f.dataType.typeName() in ("long", "integer", "double")]
    return _rounded(part.agg(*[F.sum(c).alias(f"total_{c}") for c in numbers]))


# --- names ------------------------------------------------------------------------------------------------------------------------

_FORMS = ("{K}_dt", "{K}_order_date", "seen_{K}_ts", "{K}_made_timestamp", "made_timestamp_{K}", "_dt", "{K}_xref_id", "{K}-to-{K}", "leaf_in_{K}", "UPPER_{K}_Name", "{K}_cd", "a__{K}", "key{K}", "{K}_key")
_NAME_ROWS = samples.sql_texts_for_customers(_FORMS, "name")


def _names(spark, sf):
    return samples.texts_for_customers(spark, sf, _FORMS, "name")


@query(f"SELECT name, ARRAY_TO_STRING(LIST_TRANSFORM(STRING_SPLIT(TRIM(REGEXP_REPLACE(name, '[-_]+', ' ', 'g')), ' '), lambda w: UPPER(w[1]) || LOWER(w[2:])), ' ') AS label FROM {_NAME_ROWS}")
def label_fallback(spark, sf):
    return _names(spark, sf).select("name", naming.label(F.col("name")).alias("label"))


@query(f"SELECT name, COALESCE(NULLIF(REGEXP_REPLACE(name, '(_dt|_date|_ts|_timestamp)$', ''), ''), name) AS dim_group FROM {_NAME_ROWS}")
def dim_group_name(spark, sf):
    return _names(spark, sf).select("name", naming.dimension_group_name(F.col("name")).alias("dim_group"))


@query(f"SELECT name, REGEXP_REPLACE(name, '[^A-Za-z0-9]', '_', 'g') AS safe, REGEXP_MATCHES(LOWER(name), '(_id|_xref_id|_uuid|_key|_cd)$') AS is_key FROM {_NAME_ROWS}")
def safe_key(spark, sf):
    return _names(spark, sf).select("name", naming.safe_key(F.col("name")).alias("safe"), naming.is_key_candidate(F.col("name")).alias("is_key"))


_EXPRESSIONS = ("${TABLE}.a + ${view_{K}.b_c}", "SUM(${x{K}}) / NULLIF(${y.{K}}, 0)", "no refs of {K}", "${1{K}} ${ok}")


@query("SELECT expr, ARRAY_TO_STRING(REGEXP_EXTRACT_ALL(expr, '\\$\\{([a-zA-Z_][a-zA-Z0-9_.]*)\\}', 1), ',') AS refs FROM " + samples.sql_texts_for_customers(_EXPRESSIONS, "expr"))
def ref_extract(spark, sf):
    return samples.texts_for_customers(spark, sf, _EXPRESSIONS, "expr").select("expr", F.array_join(naming.references(F.col("expr")), ",").alias("refs"))


@query("SELECT token, COUNT(*) AS n FROM (SELECT UNNEST(LIST_DISTINCT(LIST_FILTER(REGEXP_EXTRACT_ALL(LOWER(text), '[a-z][a-z0-9_]*'), lambda t: LENGTH(t) > 2))) AS token FROM conversations WHERE role = 'user') GROUP BY token")
def tokenise(spark, sf):
    rows = _reader(spark, sf)("conversations").where("role = 'user'")
    return rows.select(F.explode(naming.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# --- facets of queries on the views of each customer ----------------------------------------------------------------------------------------------------------

def _viewed(spark, sf):
    return samples.for_customers(spark, sf, samples.FACETS, "query_id string, view string, dimensions array<string>, aggregations array<struct<function:string,column:string,distinct:boolean>>, filter_columns array<string>, equality_filters array<struct<column:string,value:string>>, prompt string", "view")


_USES = samples.values_for_customers([(q, v, c) for q, v, d, a, f, _, _ in samples.FACETS for c in [*d, *[x[1] for x in a if x[1]], *f]], ("query_id", "view", "col"), "view")
_EQUALS = samples.values_for_customers([(q, v, c, x) for q, v, _, _, _, e, _ in samples.FACETS for c, x in e], ("query_id", "view", "col", "value"), "view")
_PROMPTS = samples.values_for_customers([(q, v, p) for q, v, _, _, _, _, p in samples.FACETS], ("query_id", "view", "prompt"), "view")


@query(f'SELECT view, col AS "column", COUNT(*) AS n FROM {_USES} GROUP BY view, col')
def field_frequency(spark, sf):
    return corpus.field_frequency(_viewed(spark, sf))


@query(
    f"WITH total AS (SELECT view, COUNT(*) AS k FROM {_PROMPTS} GROUP BY view), used AS (SELECT view, col, value, COUNT(DISTINCT query_id) AS n FROM {_EQUALS} GROUP BY ALL), best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY view, col ORDER BY n DESC, value) AS p FROM used) "
    'SELECT b.view, col AS "column", value, ROUND(n / k, 4) AS share FROM best b JOIN total t ON b.view = t.view WHERE p = 1 AND n >= 0.8 * k'
)
def default_filters(spark, sf):
    return corpus.default_filters(_viewed(spark, sf))


@query(
    f"WITH w AS (SELECT query_id, view, UNNEST(LIST_DISTINCT(LIST_FILTER(REGEXP_EXTRACT_ALL(LOWER(prompt), '[a-z][a-z0-9_]*'), lambda t: LENGTH(t) > 2))) AS token FROM {_PROMPTS}), u AS (SELECT DISTINCT * FROM {_USES}), "
    "c AS (SELECT w.view, token, col, COUNT(*) AS n FROM w JOIN u ON w.query_id = u.query_id AND w.view = u.view GROUP BY ALL), k AS (SELECT *, COUNT(*) OVER (PARTITION BY view, token) AS choices FROM c) "
    'SELECT view, token, col AS "column", n FROM k WHERE n >= 2 OR choices = 1'
)
def vocab_cooccurrence(spark, sf):
    return corpus.vocabulary(_viewed(spark, sf))


# --- fields: merge, catalogs, coverage --------------------------------------------------------------------------------------------

_FIELD_COLUMNS = ("view", "kind", "name", "type", "sql", "label", "description", "tags")


_FIELD_TYPES = "view string, kind string, name string, type string, sql string, label string, description string, tags array<string>"


def _one_model(spark, rows):
    return spark.createDataFrame([(*r[:7], r[7].split(",") if r[7] else []) for r in rows], _FIELD_TYPES)


def _fields(spark, sf, rows):
    return samples.for_customers(spark, sf, [(*r[:7], r[7].split(",") if r[7] else []) for r in rows], _FIELD_TYPES, "view")


_B, _E = samples.values_for_customers(samples.BASELINE, _FIELD_COLUMNS, "view"), samples.values_for_customers(samples.ENRICHED, _FIELD_COLUMNS, "view")


@query(
    "SELECT COALESCE(b.view, e.view) AS view, COALESCE(b.kind, e.kind) AS kind, COALESCE(b.name, e.name) AS name, CASE WHEN b.name IS NULL THEN e.sql ELSE b.sql END AS sql, CASE WHEN b.name IS NULL THEN e.type ELSE b.type END AS type, "
    "ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_FILTER(LIST_CONCAT(STRING_SPLIT(COALESCE(b.tags, ''), ','), STRING_SPLIT(COALESCE(e.tags, ''), ',')), lambda t: t <> ''))), ',') AS tags, COALESCE(NULLIF(b.label, ''), e.label, b.label) AS label, "
    "CASE WHEN b.name IS NOT NULL AND e.name IS NOT NULL AND LENGTH(COALESCE(b.description, '')) < 30 THEN COALESCE(NULLIF(e.description, ''), b.description) ELSE COALESCE(b.description, e.description) END AS description "
    f"FROM (SELECT * FROM {_B}) b FULL JOIN (SELECT * FROM {_E}) e ON b.view = e.view AND b.kind = e.kind AND b.name = e.name"
)
def merge_fields(spark, sf):
    merged = fields.merge_fields(_fields(spark, sf, samples.BASELINE), _fields(spark, sf, samples.ENRICHED))
    return merged.withColumn("tags", F.array_join(F.array_sort("tags"), ","))


@query(
    f"SELECT b.view, b.kind, b.name, b.description AS was, e.description AS now FROM (SELECT * FROM {_B}) b JOIN (SELECT * FROM {_E}) e ON b.view = e.view AND b.kind = e.kind AND b.name = e.name "
    "WHERE LENGTH(b.description) BETWEEN 1 AND 29 AND e.description <> '' AND e.description <> b.description"
)
def merge_ledger(spark, sf):
    return fields.overwrites(_fields(spark, sf, samples.BASELINE), _fields(spark, sf, samples.ENRICHED))


@query(f"SELECT view || '.' || name AS metric, type, sql, label FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY view, name ORDER BY label, sql) AS p FROM (SELECT * FROM {_B} UNION ALL SELECT * FROM {_E}) WHERE kind = 'measure') WHERE p = 1")
def metric_catalog(spark, sf):
    both = _fields(spark, sf, samples.BASELINE).unionByName(_fields(spark, sf, samples.ENRICHED))
    return fields.metric_catalog(both)


@query(
    f"SELECT view, COUNT(*) AS n_fields, COUNT(*) FILTER (WHERE description = '') AS no_description, COUNT(*) FILTER (WHERE LENGTH(description) BETWEEN 1 AND 29) AS short_description, COUNT(*) FILTER (WHERE label = '') AS no_label, "
    f"COUNT(*) FILTER (WHERE tags = '') AS no_tags, COUNT(*) FILTER (WHERE kind = 'measure') AS n_measures, COUNT(*) FILTER (WHERE kind = 'dimension_group') AS n_dates FROM {_B} GROUP BY view"
)
def baseline_quality(spark, sf):
    return fields.baseline_quality(_fields(spark, sf, samples.BASELINE))


def _needs(spark, sf):
    return samples.for_customers(spark, sf, samples.NEEDS, "query_id string, need string, function string, column string", "query_id")


_NEEDS = samples.values_for_customers(samples.NEEDS, ("query_id", "need", "function", "col"), "query_id")
_COVERED = (
    "ans AS (SELECT * FROM (VALUES ('SUM','sum'),('SUM','sum_distinct'),('COUNT','count'),('COUNT','count_distinct'),('AVG','average'),('AVG','average_distinct'),('MIN','min'),('MAX','max')) t(function, type)), "
    f"f AS (SELECT * FROM {samples.values(samples.ENRICHED, _FIELD_COLUMNS)}), n AS (SELECT * FROM {_NEEDS}), checked AS (SELECT query_id, need, function, col, CASE WHEN need = 'dimension' THEN EXISTS (SELECT 1 FROM f WHERE kind <> 'measure' AND (LOWER(f.name) = LOWER(col) "
    "OR LIST_CONTAINS(REGEXP_EXTRACT_ALL(LOWER(f.sql), '\\w+'), LOWER(col)))) ELSE EXISTS (SELECT 1 FROM f JOIN ans ON f.type = ans.type WHERE f.kind = 'measure' AND ans.function = n.function AND (col IS NULL OR LOWER(f.name) = LOWER(col) "
    "OR LIST_CONTAINS(REGEXP_EXTRACT_ALL(LOWER(f.sql), '\\w+'), LOWER(col)))) END AS covered FROM n)"
)


@query(f"WITH {_COVERED} SELECT query_id, BOOL_AND(covered) AS covered, COUNT(*) FILTER (WHERE NOT covered) AS missing FROM checked GROUP BY query_id")
def coverage_by_query(spark, sf):
    return fields.coverage_by_query(fields.coverage(_needs(spark, sf), _one_model(spark, samples.ENRICHED)))


@query(f"WITH {_COVERED} SELECT CONCAT_WS(' ', need, COALESCE(function, ''), COALESCE(LOWER(col), '*')) AS gap, 'prompt_fix' AS category, COUNT(*) AS n FROM checked WHERE NOT covered GROUP BY 1 ORDER BY n DESC, gap LIMIT 10")
def coverage_gaps(spark, sf):
    return fields.gaps(fields.coverage(_needs(spark, sf), _one_model(spark, samples.ENRICHED)))


@query(f"WITH {_COVERED}, now AS (SELECT query_id, BOOL_AND(covered) AS covered FROM checked GROUP BY query_id) SELECT DISTINCT query_id FROM n WHERE query_id NOT IN (SELECT query_id FROM now WHERE covered)")
def regressions(spark, sf):
    now = fields.coverage_by_query(fields.coverage(_needs(spark, sf), _one_model(spark, samples.ENRICHED)))
    return fields.regressions(now.select("query_id", F.lit(True).alias("covered")), now)


@query("SELECT o_orderpriority AS approver, o_orderstatus = 'F' AS approved, COUNT(*) AS n FROM orders GROUP BY ALL")
def approval_summary(spark, sf):
    decisions = _reader(spark, sf)("orders").select(F.col("o_orderpriority").alias("approver"), (F.col("o_orderstatus") == "F").alias("approved"))
    return fields.approval_summary(decisions)


@query("SELECT c_mktsegment AS \"table\", COUNT(*) AS n_columns, ROUND(COUNT(*) FILTER (WHERE c_acctbal > 1000) / COUNT(*), 3) AS coverage FROM customer GROUP BY c_mktsegment")
def metadata_share(spark, sf):
    described = F.when(F.col("c_acctbal") > 1000, "rich").when(F.col("c_acctbal") > 0, " ")
    return metadata_coverage(_reader(spark, sf)("customer").select(F.col("c_mktsegment").alias("table"), F.col("c_name").alias("name"), described.alias("description")))


# --- proposals and gates ----------------------------------------------------------------------------------------------------------

_TYPES = [("orders", "o_orderstatus", "STRING"), ("orders", "o_custkey", "INT64"), ("customer", "c_nationkey", "INTEGER")]
_AGGREGATES = samples.values_for_customers([(v, f, c, d) for _, v, _, a, _, _, _ in samples.FACETS for f, c, d in a], ("view", "f", "col", "dist"), "view")
_PLAIN = samples.values_for_customers([(v, c) for _, v, d, _, f, _, _ in samples.FACETS for c in [*d, *f] if c != "o_orderdate"], ("view", "col"), "view")


def _context(spark, sf):
    viewed = _viewed(spark, sf).withColumnRenamed("view", "table")
    dates = F.array(F.struct(F.lit("o_orderdate").alias("column"), F.lit("YEAR").alias("function")))
    grouped = viewed.groupBy("table").agg(F.flatten(F.collect_list("filter_columns")).alias("filter_columns"), F.flatten(F.collect_list("dimensions")).alias("dimensions"), F.flatten(F.collect_list("aggregations")).alias("aggregations"))
    return grouped.withColumn("date_parts", F.when(F.col("table").startswith("orders_"), dates).otherwise(F.array().cast("array<struct<column:string,function:string>>"))).withColumn("ctes", F.array(F.lit("recent")))


def _proposed(spark, sf):
    return proposals.propose_fields(_context(spark, sf), samples.for_customers(spark, sf, _TYPES, "table string, name string, type string", "table"))


_PROPOSED = (
    f"a AS (SELECT * FROM {_AGGREGATES}), p AS (SELECT DISTINCT view, col FROM {_PLAIN}), t AS (SELECT * FROM {samples.values_for_customers(_TYPES, ('view', 'col', 'w'), 'view')}), "
    "fields AS (SELECT p.view AS \"table\", 'dimension' AS kind, p.col AS name, CASE WHEN w IN ('NUMERIC', 'FLOAT64', 'INT64', 'INTEGER', 'NUMBER') THEN 'number' WHEN w IN ('BOOL', 'BOOLEAN') THEN 'yesno' ELSE 'string' END AS type FROM p "
    "LEFT JOIN t ON p.view = t.view AND p.col = t.col WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.view = p.view AND a.col = p.col) UNION SELECT view, 'dimension_group', 'o_orderdate', 'time' FROM a WHERE view LIKE 'orders%' UNION "
    "SELECT view, 'measure', CASE WHEN dist THEN 'unique' ELSE LIST_EXTRACT(['total', 'count', 'avg', 'min', 'max'], LIST_POSITION(['SUM', 'COUNT', 'AVG', 'MIN', 'MAX'], f)) END || '_' || col, "
    "CASE WHEN dist THEN 'count_distinct' ELSE LIST_EXTRACT(['sum', 'count', 'average', 'min', 'max'], LIST_POSITION(['SUM', 'COUNT', 'AVG', 'MIN', 'MAX'], f)) END FROM a WHERE col IS NOT NULL "
    "UNION SELECT view, 'derived_table', 'recent_dt', NULL FROM a)"
)


@query(f"WITH {_PROPOSED} SELECT * FROM fields")
def propose_fields(spark, sf):
    return _proposed(spark, sf).drop("sql")


_EXISTING = [("orders", "dimension", "o_orderstatus"), ("customer", "derived_table", "recent_dt"), ("orders", "dimension_group", "o_orderdate")]


@query(
    f"WITH {_PROPOSED}, old AS (SELECT * FROM {samples.values_for_customers(_EXISTING, ('tbl', 'kind', 'name'), 'tbl')}), new AS (SELECT f.* FROM fields f ANTI JOIN old ON f.\"table\" = old.tbl AND f.kind = old.kind AND f.name = old.name) "
    "SELECT \"table\", COUNT(*) AS n_changes, COUNT(*) FILTER (WHERE kind IN ('primary_key', 'dimension_group', 'derived_table', 'case_dimension')) = 0 AS auto_approved FROM new GROUP BY 1"
)
def auto_approval(spark, sf):
    return proposals.auto_approved(proposals.changes(_proposed(spark, sf), samples.for_customers(spark, sf, _EXISTING, "table string, kind string, name string", "table")))


_REVIEWS = [
    ("orders", "- [x] APPROVED\n- [ ] REJECTED\n"),
    ("customer", "- [x] APPROVED\n- [X] REJECTED\nFeedback: rename it"),
    ("part", "- [ ] APPROVED\n- [ ] REJECTED\nFeedback:"),
    ("nation", "* [x] REJECTED\n"),
]
_REVIEW_ROWS = samples.values_for_customers(_REVIEWS, ("tbl", "text"), "tbl")
_DECIDED = (
    f"r AS (SELECT tbl, text, REGEXP_EXTRACT_ALL(text, '(?m)^\\s*[-*]\\s*\\[[xX]\\]\\s*(APPROVED|REJECTED)', 1) AS t FROM {_REVIEW_ROWS}), "
    "decided AS (SELECT tbl, CASE WHEN LEN(t) > 0 THEN LOWER(t[-1]) ELSE 'pending' END AS decision, TRIM(REGEXP_EXTRACT(text, '(?is)feedback:\\s*(.*)$', 1)) AS feedback FROM r)"
)


def _reviews(spark, sf):
    return samples.for_customers(spark, sf, _REVIEWS, "table string, text string", "table")


@query(f'WITH {_DECIDED} SELECT tbl AS "table", decision, feedback FROM decided')
def review_decisions(spark, sf):
    return proposals.approvals(_reviews(spark, sf))


@query(
    f"WITH {_DECIDED}, n AS (SELECT COUNT(*) FILTER (WHERE decision = 'pending') AS p, COUNT(*) FILTER (WHERE decision = 'rejected' AND feedback = '') AS m, COUNT(*) FILTER (WHERE decision = 'approved') AS a, COUNT(*) AS k FROM decided) "
    "SELECT CASE WHEN p + m > 0 THEN 'fail' WHEN 2 * a < k THEN 'warn' ELSE 'pass' END AS status, CONCAT_WS('; ', CASE WHEN p > 0 THEN p || ' pending' END, CASE WHEN m > 0 THEN m || ' rejected without feedback' END) AS blocking, "
    "COALESCE(CASE WHEN 2 * a < k THEN 'under half approved' END, '') AS warnings FROM n"
)
def approval_gate(spark, sf):
    return proposals.approval_gate(_reviews(spark, sf).select("table"), proposals.approvals(_reviews(spark, sf)))


_PLANNED = [("orders",), ("part",)]


@query(
    f"WITH {_PROPOSED} SELECT tbl AS \"table\", 'no dimension or measure' AS fault FROM {samples.values_for_customers(_PLANNED, ('tbl',), 'tbl')} WHERE tbl NOT IN (SELECT \"table\" FROM fields WHERE kind IN ('dimension', 'measure')) "
    "UNION ALL SELECT NULL, 'too many tokens' WHERE (SELECT SUM(100 * c_custkey) FROM customer) > 800000"
)
def planning_gate(spark, sf):
    tokens = _reader(spark, sf)("customer").select((100 * F.col("c_custkey")).alias("tokens"))
    return proposals.planning_gate(samples.for_customers(spark, sf, _PLANNED, "table string", "table"), _proposed(spark, sf), tokens)


# --- profiles ---------------------------------------------------------------------------------------------------------------------


@query(
    "SELECT col AS \"column\", COUNT(*) AS non_empty, COUNT(DISTINCT v) AS distinct_count, ROUND(AVG(LENGTH(v)), 1) AS avg_length, MAX(LENGTH(v)) AS max_length FROM (SELECT 'lang' AS col, TRIM(lang) AS v FROM documents "
    "UNION ALL SELECT 'source', TRIM(source) FROM documents UNION ALL SELECT 'doc_id', CAST(doc_id AS VARCHAR) FROM documents) WHERE v <> '' GROUP BY col"
)
def profile_columns(spark, sf):
    return profile.column_summary(_reader(spark, sf)("documents"), ["lang", "source", "doc_id"])


@query(
    "SELECT col AS \"column\", ARRAY_TO_STRING((LIST(v ORDER BY v))[1:50], '|') AS \"values\", COUNT(*) > 50 AS truncated FROM (SELECT DISTINCT 'event_type' AS col, event_type AS v FROM events WHERE event_type IS NOT NULL UNION ALL "
    "SELECT DISTINCT 'props', props FROM events WHERE props IS NOT NULL) GROUP BY col"
)
def profile_distinct(spark, sf):
    return profile.distinct_values(_reader(spark, sf)("events"))


@query("SELECT 'k' AS key, COUNT(*) AS n, ROUND(SUM(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 2) AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_keys(spark, sf):
    return profile.json_keys(_reader(spark, sf)("events"), "props")


@query("SELECT AVG(CASE WHEN REGEXP_MATCHES(text, '(?is)\\bselect\\b.*\\bfrom\\b') THEN 1.0 ELSE 0.0 END) AS share FROM documents WHERE TRIM(text) <> ''")
def sql_detect(spark, sf):
    docs = _reader(spark, sf)("documents").where("trim(text) <> ''")
    return docs.agg(F.avg(F.col("text").rlike(r"(?is)\bselect\b.*\bfrom\b").cast("double")).alias("share"))


@query("SELECT doc_id, LENGTH(TRIM(TRANSLATE(text, '‘’“” ', '''''\"\" '))) AS n FROM documents")
def text_clean(spark, sf):
    return _reader(spark, sf)("documents").select("doc_id", F.length(sqltext.cleaned(F.col("text"))).cast("bigint").alias("n"))
