"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts can be long, so batches stay small.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches that Python workers hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables; a temporary one only where the setting is absent, as in local tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in local tests, a temporary folder is used.
    """
    folder = shared_folder(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def names_apart(*read: str, replaced: tuple[str, ...] = (), named: tuple[str, ...] = ()) -> Callable:
    """For operators on frames: their internal columns never meet the given frame's.

    Columns that the operator doesn't read (``read``, and the one named by ``text``) are numbered inside and get their names back in the
    result; those named as its results (``replaced``, and what the arguments ``named`` say) are left out.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        takes = signature(operator)

        @wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            given = takes.bind(docs, *args, **options)
            given.apply_defaults()
            known = {*read, given.arguments.get("text", "text")}
            gone = {c.lower() for c in (*replaced, *(given.arguments[n] for n in named))} - {c.lower() for c in known}
            back = {f"given{i}": c for i, c in enumerate(docs.columns) if c not in known and c.lower() not in gone}
            inside = {c: i for i, c in back.items()}
            plain = docs.select(*[quoted(c).alias(inside.get(c, c)) for c in docs.columns if c in known or c in inside])
            out = operator(plain, *args, **options)
            return out.select(*[quoted(c).alias(back.get(c, c)) for c in out.columns])

        return run

    return wrap


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable vertex of every vertex in ``edges(a, b)``: columns ``node, label``.

    Alternates large-star and small-star steps until every vertex points straight to its component's smallest one.  Hubs are aggregated
    with a map-side minimum, so no neighbour list is gathered, and the joins' keys are structs that only they use, so Spark can split
    a hot hub.
    """
    work = checkpoint(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u > v").distinct())
    while has_rows(_bent(work)):
        work = checkpoint(_straighter(work))
    labels = work.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionAll(labels.select(F.col("label").alias("node"), "label").distinct())


def _bent(edges: DataFrame) -> DataFrame:
    """Vertices that point to several others, or to one and are pointed to as well."""
    ends = edges.select(F.explode(F.expr("array(struct(u as node, 1 as out, 0 as into), struct(v as node, 0 as out, 1 as into))")).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and all v of the same u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.struct("u").alias("key"), F.least("u", "m").alias("m"))
    return edges.withColumn("key", F.struct("u")).join(least, "key").select("u", "v", "m")


def _straighter(edges: DataFrame) -> DataFrame:
    # large-star: every larger neighbour of a vertex is linked to the smallest vertex around it
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # small-star: the smaller neighbours, and the vertex itself, are linked to the smallest of them
    small = _with_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return small.where("u > v").distinct()
