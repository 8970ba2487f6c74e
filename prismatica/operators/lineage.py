"""Results that several plans or rounds read, written once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """Rows checkpointed in the folder that the session names; in a temporary one only where it names none, as in tests."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return rows.checkpoint()
