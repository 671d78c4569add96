"""The corpus pipeline: each stage works on what its predecessor kept.

Stages with Python workers lower the session's Arrow batches to `common.BATCH_ROWS` rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergence.llm import decontam, langid, lines, minhash
from vergence.llm.common import cut, shared_dir, sized_broadcast, small_batches
from vergence.llm.registry import bpe_round_trip, language_models

#: Characters of a block of documents in byte_bpe: less than in the operator, since an executor's JVM has grown by then.
BPE_BLOCK_BYTES = 2 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the languages go."""
    small_batches(spark)
    return langid.identify(docs, language_models(docs)).where(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier one go from the texts; n_chars follows."""
    return lines.dedup_lines(docs, least_words=lines.EVERY_LINE).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the least id stays."""
    small_batches(spark)
    gone = cut(minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(sized_broadcast(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(docs, items).where(~F.col("contaminated")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    small_batches(spark)
    return bpe_round_trip(docs, BPE_BLOCK_BYTES)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: Models of language and rarity, similarity joins and byte-level BPE have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/vergence-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}-{name}")
        docs = spark.read.parquet(f"{top}/{i}-{name}")
    return docs
