"""A corpus that grows: fingerprints of new query files, and field counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from prismatica.operators.corpus import by_view, field_frequency, fingerprints


def new_queries(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """A stream of (query_id, prompt, sql), one row for each new *.sql file."""
    rows = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_a_trigger).text(f"{folder}/*.sql")
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.sql$", "")
    return rows.select(name.alias("query_id"), name.alias("prompt"), F.col("value").alias("sql"))


def follow_field_frequency(queries: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream that counts the fields of each micro-batch of queries into ``folder``; a repeated batch replaces its counts."""

    def count(batch: DataFrame, number: int) -> None:
        field_frequency(by_view(fingerprints(batch))).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return queries.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def field_frequency_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """view, column, n over all queries that were counted."""
    return spark.read.parquet(folder).groupBy("view", "column").agg(F.sum("n").alias("n"))
