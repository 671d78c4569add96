"""The registered queries of the training-data operators: name to (query, SQL or None)."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vergence.sources.views import spread

from vergence.llm import alignment, bpe, chat, decontam, divergence, langid, lines, minhash, quality, secrets, sharding, sql, tokencount, vectors


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _vocabulary(name: str) -> bytes:
    """The driver reads a vocabulary file; its bytes go to the tasks."""
    return Path(public_tokenizers.path(name)).read_bytes()


def _fold(folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def language_models(docs: DataFrame) -> langid.Models:
    """Of the folds 0 and 1 of four, calibrated on fold 3; fold 2 is held out."""
    return langid.fit(docs.where(_fold(4) < 2), docs.where(_fold(4) == 3))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.identify(docs.select("doc_id", "text"), language_models(docs.select("doc_id", "lang", "text")))
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.transform(F.filter("found", lambda x: x["coverage"] >= decontam.COVERAGE), lambda x: x["item_id"])
    return found.select("doc_id", "contaminated", "coverage", F.array_sort(F.array_distinct(ids)).alias("item_ids"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    placed = sharding.shard(_documents(spark, sf_dir))
    return placed.select("doc_id", F.col("record_bytes").alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), least_words=lines.EVERY_LINE).select("doc_id", "line_count", "removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_documents(spark, sf_dir)))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = quality.labelled(docs, labels.where(_fold(3) != 1), "doc_id", "quality")
    found = quality.score(docs, quality.fit(known))
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def bpe_round_trip(docs: DataFrame, block_bytes: int = bpe.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the texts' ids and of what these decode to."""
    ranks = _vocabulary("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, block_bytes=block_bytes, decoded=True)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    marks = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(rows.unionByName(own).withColumn("parts", chat.text_part(F.col("text")))))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_documents(spark, sf_dir))


QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_decontamination": (op2_decontamination, None),
    "op3_sharding": (op3_sharding, None),
    "op4_line_dedup": (op4_line_dedup, None),
    "op5_secret_scan": (op5_secret_scan, None),
    "op6_embedding_near_dedup": (op6_embedding_near_dedup, None),
    "op7_quality": (op7_quality, None),
    "op8_minhash_near_dedup": (op8_minhash_near_dedup, None),
    "op9_byte_bpe": (op9_byte_bpe, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_chat_formatting": (op11_chat_formatting, sql.OP11),
    "op12_cross_tokenizer_alignment": (op12_cross_tokenizer_alignment, None),
    "op13_source_divergence": (op13_source_divergence, sql.OP13),
}
