"""Corpus pipeline: quality, spread lines, near-duplicates, benchmark leaks, source mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame over all rows of
``docs``; the caller writes it as Parquet and hands the reread table to the next
stage. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from turnledger.llm import decontaminate, line_spread, mixing, near_dup, quality_model
from turnledger.llm.shared import without
from turnledger.session import checkpoint_dir


#: Texts per Arrow batch: the stages keep few of them in memory at a time, in the JVM as in Python.
BATCH = "500"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; trained on the labelled rows of ``docs``; an empty table gives an empty one."""
    _small_batches(spark)
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sources; n_chars follows the text where the table has it."""
    from pyspark.sql import functions as F

    cleaned = line_spread.remove_spread_lines(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 on five-word shingles: the one with the smallest id."""
    _small_batches(spark)
    dropped = near_dup.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return without(docs, "doc_id", dropped)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no part of a benchmark item stands; null and empty texts stay."""
    _small_batches(spark)
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix over all remaining documents: doc_id, source, size, source_size, target, copies, taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]

#: The classifier and the subset sums have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
