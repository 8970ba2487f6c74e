"""Registered queries over the words of fields that grow with the tables: one field for each customer, ten to a concept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatica.operators import vocabulary
from prismatica.registry import query
from prismatica.samples import values

#: By c_custkey % 10: kind, type, name, sql, label, description, tags (joined by |).  {G}: the group, c_custkey // 10.
FIELDS = (
    ("dimension", "number", "n{G}", "${TABLE}.n{G}", "Total Spend", "Spend of a customer, gross", "NAA"),
    ("dimension", "number", "m{G}", "${TABLE}.n{G}", "Billed Business", "Spend of a customer, gross", "NAA"),
    ("dimension", "number", "O{G}", " ${v.m{G}} ", "total  spend", "spend of a customer: gross", "NAA"),
    ("dimension", "number", "n{G}", None, "Gross Total", "Spend of a customer, gross", "NAA"),
    ("dimension", "number", "n{G}", None, "Total Spend", "Spend of a customer, net", "NAA"),
    ("dimension", "number", "n{G}", None, "Total Spend", "Unknown", "NAA"),
    ("dimension", "number", "n{G}", "${TABLE}.a + ${TABLE}.b", "Total Spend", "Spend of a customer, gross", ""),
    ("dimension", "number", "n{G}", None, "Total Spend", "Spend of a card member, gross", "NAA"),
    ("measure", "sum", "n{G}", "${TABLE}.n{G}", "Sum", "Unlike the others", ""),
    ("dimension", "number", "N{G}", None, None, None, "NAA|x"),
)
TERMS = [("Card Member", "customer"), ("client", "customer"), ("gross", "brutto")]
#: Fixed values by place: what is wrong with each field.
ISSUES = [
    (1, "label", "high", "Billed Business", "Total Spend"),
    (2, "label", "low", "total  spend", "Total Spend"),
    (3, "label", "medium", "Gross Total", "Total Spend"),
    (4, "description", "high", "Spend of a customer, net", "Spend of a customer, gross"),
    (5, "description", "medium", "Unknown", "Spend of a customer, gross"),
    (6, "tag", "medium", None, "NAA"),
    (7, "term", "medium", "card member", "customer"),
    *[(k, "tag", "low", None, "x") for k in range(8)],
]


def fields_of_customers(spark: SparkSession, sf: str) -> DataFrame:
    made = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.floor(F.col("c_custkey") / 10)).cast("string").alias("g"))
    place = (F.col("c_custkey") % 10 + 1).cast("int")
    said = lambda n: F.replace(F.element_at(F.array(*[F.lit(f[n]) for f in FIELDS]), place), F.lit("{G}"), F.col("g"))
    names = ("kind", "type", "name", "sql", "label", "description")
    return made.select(F.concat(F.lit("v"), "c_custkey").alias("view"), *[said(n).alias(c) for n, c in enumerate(names)], F.filter(F.split(said(6), r"\|"), lambda t: t != "").alias("tags"))


# A group is compared where it has two fields at least; its least member names it.
_ALL = (
    "SELECT CASE WHEN k = 8 THEN 'measure sum:n' ELSE 'dimension:m' END || c_custkey // 10 AS concept, 'v' || c_custkey AS view, issue, severity, found, expected "
    f"FROM customer JOIN {values(ISSUES, ('k', 'issue', 'severity', 'found', 'expected'))} ON c_custkey % 10 = k WHERE c_custkey // 10 * 10 + 9 <= (SELECT MAX(c_custkey) FROM customer)"
)


@query(_ALL)
def vocabulary_issues(spark, sf):
    terms = spark.createDataFrame(TERMS, "term string, canonical string")
    return vocabulary.issues(fields_of_customers(spark, sf), terms).select("concept", "view", "issue", "severity", "found", "expected")


@query(f"SELECT COUNT(*) = 0 AS consistent, COUNT(*) FILTER (WHERE severity = 'high') AS high, COUNT(*) FILTER (WHERE severity = 'medium') AS medium, COUNT(*) FILTER (WHERE severity = 'low') AS low FROM ({_ALL})")
def vocabulary_report(spark, sf):
    return vocabulary.report(vocabulary.issues(fields_of_customers(spark, sf), spark.createDataFrame(TERMS, "term string, canonical string")))


@query(
    "SELECT CASE WHEN c_custkey % 10 = 8 THEN 'measure sum:n' WHEN EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey = c.c_custkey // 10 * 10 + 1) THEN 'dimension:m' ELSE 'dimension:n' END || c_custkey // 10 AS concept, COUNT(*) AS fields FROM customer c GROUP BY 1"
)
def concept_sizes(spark, sf):
    return vocabulary.concepts(fields_of_customers(spark, sf)).groupBy("concept").agg(F.count("*").alias("fields"))
