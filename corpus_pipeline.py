"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents.

Every stage works on all that its predecessor kept.  The first four return the columns of documents as they came in; the last adds the
token ids and the text decoded from them.  The steps, in order:

1. quality: documents that the classifier scores under its threshold go; it learns from labels that are not held out.
2. near_duplicates: of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the least id stays.
3. decontamination: documents that leak a benchmark item go.
4. secrets: spans that the scan reports are blanked out of the text.
5. bpe: token ids of the remaining text, and the text decoded from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatica.llm import bpe_codec, decontaminate, minhash, quality_crf, secret_scan
from prismatica.llm.common import quoted, shared_folder, table, unused

MASK = "[redacted]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score at least the threshold; a null text scores as an empty one."""
    # Labels belong to the documents of the input table, so the field is fitted on what this stage was given.
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return quality_crf.score(docs, model, score).where(F.col(score) >= quality_crf.THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one with the least id; of rows with the same id and the same text, all or none.  Rows with
    a null id, and documents without words, always stay."""
    text_hash = unused(docs, "text_hash")
    classes = minhash.link_classes(docs.select("doc_id", "text"), words=5, similarity=0.8, text_hash=text_hash)
    gone = classes.where("doc_id is not null and component_id is not null and doc_id > component_id").select("doc_id", text_hash).distinct()
    return docs.withColumn(text_hash, F.xxhash64("text")).join(gone, ["doc_id", text_hash], "left_anti").select(*map(quoted, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blanks every reported span out of the texts; documents stay, n_chars counts the new text."""
    return secret_scan.redact(docs, MASK)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids and decoded."""
    return bpe_codec.encode_decode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("bpe", bpe)]

#: SQL can't express the classifier or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each stage keeps is written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
