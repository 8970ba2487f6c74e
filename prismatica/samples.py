"""Rows of our own about the driver's tables, and what makes them grow: each is repeated for every customer, under the customer's names."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

CORPUS = [
    ("Q01", "returned revenue in 1996", "SELECT SUM(l_extendedprice) FROM dw.lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'"),
    ("Q02", "order value of 1996", "SELECT SUM(o_totalprice) FROM dw.orders WHERE EXTRACT(YEAR FROM o_orderdate) = 1996 AND o_orderstatus = 'F'"),
    ("Q03", "average balance by segment", "SELECT c_mktsegment, AVG(c_acctbal) AS avg_balance FROM customer GROUP BY c_mktsegment"),
    ("Q04", "revenue in millions by flag", "SELECT l_returnflag, ROUND(SUM(l_extendedprice) / 1e6, 2) AS m FROM dw.lineitem WHERE EXTRACT(YEAR FROM l_shipdate) = 1997 GROUP BY l_returnflag"),
    ("Q05", "value by priority", "SELECT o_orderpriority, SUM(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 0 GROUP BY o_orderpriority ORDER BY total DESC"),
    ("Q06", "monthly value", "SELECT EXTRACT(MONTH FROM o_orderdate) AS m, SUM(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY m"),
    ("Q07", "value by status", "SELECT o_orderstatus, SUM(o_totalprice), COUNT(DISTINCT o_custkey) FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus"),
    ("Q08", "customers without orders", "SELECT COUNT(DISTINCT c_custkey) FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL"),
    ("Q09", "banded value", "WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT c_custkey, c_acctbal FROM customer) SELECT CASE WHEN b.c_acctbal >= 7500 THEN 'top' ELSE 'rest' END AS band, SUM(o.o_totalprice) AS total FROM o LEFT JOIN b ON o.o_custkey = b.c_custkey GROUP BY 1"),
    ("Q10", "revenue by region", "SELECT r_name, SUM(l_extendedprice) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
]

#: query_id, view, dimensions, aggregations (function, column, distinct), filter columns, equality filters (column, value), prompt
FACETS = [
    ("Q1", "orders", [], [("SUM", "o_totalprice", False)], ["o_orderstatus", "o_orderdate"], [("o_orderstatus", "'F'")], "Total price of final orders"),
    ("Q2", "orders", ["o_orderpriority"], [("SUM", "o_totalprice", False)], ["o_orderstatus"], [("o_orderstatus", "'F'")], "price by priority"),
    ("Q3", "orders", ["o_orderpriority"], [("COUNT", None, False)], ["o_orderstatus"], [("o_orderstatus", "'F'")], "orders by priority"),
    ("Q4", "orders", [], [("AVG", "o_totalprice", False)], ["o_orderstatus"], [("o_orderstatus", "'O'")], "average price"),
    ("Q5", "orders", [], [("MAX", "o_totalprice", False)], ["o_orderstatus", "o_custkey"], [("o_orderstatus", "'F'"), ("o_custkey", "7")], "largest price of a customer"),
    ("Q6", "customer", ["c_mktsegment"], [("AVG", "c_acctbal", False)], [], [], "average balance by segment"),
    ("Q7", "customer", ["c_mktsegment"], [("COUNT", "c_custkey", True)], ["c_nationkey"], [("c_nationkey", "3")], "customers by segment"),
]

#: view, kind, name, type, sql, label, description, tags
BASELINE = [
    ("orders", "dimension", "o_orderkey", "number", "${TABLE}.o_orderkey", "", "Key", "primary_key"),
    ("orders", "dimension", "o_orderstatus", "string", "${TABLE}.o_orderstatus", "Status", "The status of an order as the warehouse keeps it", "status"),
    ("orders", "dimension_group", "ordered", "time", "${TABLE}.o_orderdate", "", "", ""),
    ("orders", "measure", "n", "count", "", "Orders", "How many", ""),
    ("customer", "dimension", "c_mktsegment", "string", "${TABLE}.c_mktsegment", "Segment", "", ""),
]
ENRICHED = [
    ("orders", "dimension", "o_orderkey", "number", "${TABLE}.key", "Order key", "Unique number of an order", "id"),
    ("orders", "dimension", "o_orderstatus", "string", "${TABLE}.status", "Order status", "Shorter", "status,state"),
    ("orders", "dimension_group", "ordered", "time", "${TABLE}.o_orderdate", "Ordered", "Day on which the order was placed", "date"),
    ("orders", "measure", "n", "count", "", "Orders placed", "Number of orders placed", "volume"),
    ("orders", "measure", "total_price", "sum", "${TABLE}.o_totalprice", "Total price", "Sum of the prices of orders", "value"),
    ("orders", "dimension", "o_orderpriority", "string", "${TABLE}.o_orderpriority", "Priority", "How urgent an order is", ""),
    ("customer", "measure", "avg_balance", "average", "${TABLE}.c_acctbal", "Average balance", "Mean of account balances", "value"),
]

#: query_id, need, function, column
NEEDS = [
    ("Q1", "measure", "SUM", "o_totalprice"),
    ("Q1", "dimension", None, "O_OrderPriority"),
    ("Q2", "measure", "COUNT", None),
    ("Q2", "dimension", None, "o_orderdate"),
    ("Q3", "measure", "AVG", "o_totalprice"),
    ("Q3", "dimension", None, "c_nationkey"),
    ("Q4", "measure", "AVG", "c_acctbal"),
    ("Q5", "measure", "MAX", "o_totalprice"),
    ("Q5", "dimension", None, "c_nationkey"),
]


def values(rows, columns) -> str:
    """The rows as a VALUES list with column names, so that SQL starts from the same input."""

    def literal(x) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ") t(" + ", ".join(columns) + ")"


def _named(value, kind):
    """Tuples as objects with the names of a schema."""
    if isinstance(kind, StructType):
        return {f.name: _named(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    return [_named(v, kind.elementType) for v in value] if isinstance(kind, ArrayType) else value


def for_customers(spark: SparkSession, sf: str, rows, schema: str, *own: str) -> DataFrame:
    """The rows once for each customer; values of the columns in ``own`` end with the customer's number."""
    kind = StructType.fromDDL(schema)
    one = F.from_json(F.lit(json.dumps([_named(r, kind) for r in rows])), f"array<{kind.simpleString()}>")
    made = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.explode(one).alias("r")).select("c_custkey", "r.*")
    return made.select(*[F.concat_ws("_", c, "c_custkey").alias(c) if c in own else F.col(c) for c in kind.names])


def values_for_customers(rows, columns, *own: str) -> str:
    """The same rows in SQL."""
    said = ", ".join(f"{c} || '_' || c_custkey AS {c}" if c in own else c for c in columns)
    return f"(SELECT {said} FROM customer CROSS JOIN {values(rows, columns)}) t"


def texts_for_customers(spark: SparkSession, sf: str, forms, name: str) -> DataFrame:
    """Each form for each customer, {K} being the segment and number."""
    made = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lower("c_mktsegment"), "c_custkey").alias("k"), F.explode(F.array(*map(F.lit, forms))).alias("form"))
    return made.select(F.replace("form", F.lit("{K}"), F.col("k")).alias(name))


def sql_texts_for_customers(forms, name: str) -> str:
    return f"(SELECT REPLACE(form, '{{K}}', LOWER(c_mktsegment) || c_custkey) AS {name} FROM customer CROSS JOIN {values([(f,) for f in forms], ('form',))}) t"
