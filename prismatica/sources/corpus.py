"""Corpora of queries and metadata documents as DataFrames, and the sinks of what is made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """key, number: places from 1 in the order of a key without repeats.

    Keys alone are sorted by ranges and counted within each; only one row for each range meets in one task.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # A fixed number of ranges, so that both reads below see the same ones.
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = rows.select(key).repartitionByRange(ranges, key).sortWithinPartitions(key).select(key, F.spark_partition_id().alias("range"), place.alias("place"))
    so_far = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = slim.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    return slim.join(before, "range").select(key, (F.col("before") + F.col("place") + 1).alias("number"))


def sql_files(spark: SparkSession, folder: str) -> DataFrame:
    """query_id (Q01, ... by file name), prompt, sql: one row for each *.sql file; an error if there is none."""
    files = spark.read.text(f"{folder}/*.sql", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("sql"))
    return files.join(numbered(files, "file"), "file").select(F.format_string("Q%02d", "number").alias("query_id"), F.regexp_replace("file", r"\.sql$", "").alias("prompt"), "sql")


def sheet(spark: SparkSession, path: str, prompt: str, sql: str, difficulty: str | None = None, natural_id: str | None = None) -> DataFrame:
    """Rows of a CSV sheet with columns found by header, whatever their case; rows without prompt and SQL are skipped.

    Ids are natural ones, else q_0001 and so on in file order.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {c.lower(): c for c in rows.columns}

    def column(name: str | None):
        if name is None:
            return F.lit(None).cast("string")
        if name not in rows.columns and name.lower() not in names:
            raise ValueError(f"no column {name!r}; there are {rows.columns}")
        return F.col(f"`{name if name in rows.columns else names[name.lower()]}`")

    rows = rows.withColumn("__n", F.monotonically_increasing_id())
    found = rows.select(column(natural_id).alias("id"), column(prompt).alias("prompt"), column(sql).alias("sql"), column(difficulty).alias("difficulty"), "__n")
    found = found.where((F.trim(F.coalesce("prompt", F.lit(""))) != "") | (F.trim(F.coalesce("sql", F.lit(""))) != ""))
    found = found.join(numbered(found, "__n"), "__n")
    return found.select(F.coalesce("id", F.format_string("q_%04d", "number")).alias("query_id"), "prompt", "sql", "difficulty")


#: Rows of a preview, and of a range, at most.
MOST_PREVIEW, MOST_RANGE = 50, 1000


def sheet_sizes(sheets: dict[str, DataFrame]) -> DataFrame:
    """sheet, rows, columns: how large each sheet is; rows without any value count, too."""
    sizes = [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("sheet"), "rows", F.lit(len(rows.columns)).alias("columns")) for name, rows in sheets.items()]
    out = sizes[0]
    for more in sizes[1:]:
        out = out.unionByName(more)
    return out


def row_range(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (from 1, both included) in the order of a key without repeats, with their number; at most 1,000.

    A range that begins before 1 or ends before it begins is an error; rows after the last one aren't there.  The clash of a column
    named ``number`` is an error, too.
    """
    if first < 1 or last < first:
        raise ValueError(f"no range of rows: {first} to {last}")
    if "number" in rows.columns:
        raise ValueError("rows have a column 'number'")
    wanted = numbered(rows, key).where(F.col("number").between(first, min(last, first + MOST_RANGE - 1)))
    return rows.join(wanted, key).select("number", *[F.col(f"`{c}`") for c in rows.columns])


def preview(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows in the order of the key, at most 50, with their number."""
    return row_range(rows, key, 1, max(1, min(n, MOST_PREVIEW)))


#: The metadata service's answer: one list element for each table.
METADATA_SCHEMA = (
    "display_name string, storage_type string, load_type string, "
    "schema struct<schema_attributes: array<struct<attribute_details: struct<attribute_name: string, business_name: string, attribute_type: string, attribute_desc: string, is_partitioned: boolean>, "
    "sensitivity_details: struct<is_pii: boolean, is_gdpr: boolean>>>>"
)


def metadata_cache(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each column that a cached answer <table>.json describes."""
    raw = spark.read.schema(METADATA_SCHEMA).json(f"{folder}/*.json", multiLine=True)
    raw = raw.withColumn("table", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", ""))
    return raw.select("table", F.explode_outer("schema.schema_attributes").alias("a")).select(
        "table",
        F.col("a.attribute_details.attribute_name").alias("name"),
        F.col("a.attribute_details.business_name").alias("business_name"),
        F.col("a.attribute_details.attribute_type").alias("type"),
        F.col("a.attribute_details.attribute_desc").alias("description"),
        F.coalesce("a.attribute_details.is_partitioned", F.lit(False)).alias("is_partitioned"),
        F.coalesce("a.sensitivity_details.is_pii", F.lit(False)).alias("is_pii"),
        F.coalesce("a.sensitivity_details.is_gdpr", F.lit(False)).alias("is_gdpr"),
    )


def metadata_coverage(columns: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """table, n_columns, coverage (share of described columns, three digits); tables without metadata have 0."""
    described = F.coalesce(F.trim("description"), F.lit("")) != ""
    found = columns.where("name is not null").groupBy("table").agg(F.count("*").alias("n_columns"), F.round(F.count_if(described) / F.greatest(F.count("*"), F.lit(1)), 3).alias("coverage"))
    if tables is None:
        return found
    return tables.select("table").distinct().join(found, "table", "left").select("table", F.coalesce("n_columns", F.lit(0)).cast("bigint").alias("n_columns"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def model_file_kind(path):
    """Kind of a model file by its most specific suffix."""
    p = F.lower(path)
    return (
        F.when(p.endswith(".view.lkml") | p.endswith(".view.lookml"), "view")
        .when(p.endswith(".model.lkml"), "model")
        .when(p.endswith(".explore.lkml"), "explore")
        .when(p.endswith(".dashboard.lookml") | p.endswith(".dashboard.lkml"), "dashboard")
        .when(p.rlike(r"(^|/)manifest\.lkml$"), "manifest")
        .when(p.endswith(".lkml") | p.endswith(".lookml"), "lookml")
    )


#: Prefixes under which a table's baseline file may be named.
BASELINE_PREFIXES = ("bq_", "dw_", "edw_", "fact_", "dim_")


def resolve_baselines(tables: DataFrame, files: DataFrame) -> DataFrame:
    """table, path: the best baseline of files(path, head) for each table.

    In order: <table>.view.lkml at the root, below it, under a known prefix, or a file whose head declares the view.
    """
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.view\.lkml$", "")
    by_name = files.select("path", "head", base.alias("name"), F.explode(F.array(base, *[F.when(base.startswith(p), F.substring(base, len(p) + 1, 10_000)) for p in BASELINE_PREFIXES])).alias("table")).where("table is not null")
    named = by_name.select("table", "path", F.when(F.col("name") != F.col("table"), 2).when(F.instr("path", "/") == 0, 0).otherwise(1).alias("score"))
    declared = files.select(F.explode(F.regexp_extract_all("head", F.lit(r"\bview:\s*(\w+)\s*\{"), F.lit(1))).alias("table"), "path", F.lit(3).alias("score"))
    ranked = tables.select("table").distinct().join(named.unionByName(declared), "table")
    return ranked.withColumn("n", F.row_number().over(Window.partitionBy("table").orderBy("score", "path"))).where("n = 1").select("table", "path")


def publish(result: DataFrame, path: str, form: str = "json") -> None:
    result.write.mode("overwrite").format(form).save(path)
