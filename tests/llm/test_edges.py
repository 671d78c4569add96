"""All operators on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tests.llm.fixtures import docs, rows
from vergence.llm import bpe, decontam, langid, lines, minhash, quality, registry, secrets, sharding, tokencount, vectors


def benchmark(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (1, "word"), (2, None), (None, "alpha beta gamma delta epsilon"), (3, "")], "item_id long, text string")


def language(spark, d):
    return langid.identify(d, langid.fit(d, d))


def scored(spark, d):
    return quality.score(d, quality.fit(d.withColumn("label", F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") % 3 == 0, 0))))


OPERATORS = {
    "language": language,
    "decontam": lambda spark, d: decontam.contamination(d, benchmark(spark)),
    "shard": lambda spark, d: sharding.shard(d, 4, bucket_bytes=100_000),
    "lines": lambda spark, d: lines.dedup_lines(d, counters=1 << 10),
    "secrets": lambda spark, d: secrets.scan(d),
    "quality": scored,
    "minhash": lambda spark, d: minhash.near_duplicates(d),
    "bpe": lambda spark, d: registry.bpe_round_trip(d),
    "tokens": lambda spark, d: tokencount.token_counts(d, registry._vocabulary("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(spark, name):
    found = OPERATORS[name](spark, docs(spark)).collect()
    ids = lambda xs: sorted(str(x) for x in xs)
    assert ids(r["doc_id"] for r in found) == ids(d for d, _ in rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).count() == 0


def test_empty_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_no_items(spark):
    found = decontam.contamination(docs(spark), benchmark(spark).where("false"))
    assert found.where("contaminated or size(found) > 0").count() == 0


def test_public_pattern_is_used(spark):
    assert bpe.read_ranks(registry._vocabulary("byte_bpe_multi_50k.tiktoken")) and public_tokenizers.PATTERN
