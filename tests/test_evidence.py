"""Each rule of retrieval changes what governed_evidence gives."""

import os

import pytest
from pyspark.sql import functions as F

from vergence.operators import ranking, retrieval
from vergence.plans import evidence
from vergence.sources import views

SF = "/root/testdata/sf0.001"


def test_all_rules_fire(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    facts = views.table(spark, SF, "part").selectExpr(*evidence._facts("make_dt_interval(cast(p_size * 4 as int))", "array")).cache()
    chunks = facts.select("asset_id", "version_no", F.posexplode("chunks").alias("seq", "chunk")).cache()
    asked = views.asks(spark, SF).select("query_id", "question").cache()
    now = F.lit(views.AS_OF).cast("timestamp")
    rows = lambda df: {(r["query_id"], r["rank"], r["asset_id"], r["seq"], r["score"]) for r in df.select("query_id", "rank", "asset_id", "seq", F.round("score", 5).alias("score")).collect()}
    hits = retrieval.retrieve(asked, facts, chunks, 5, as_of=now).cache()
    every = rows(ranking.field_directed(hits, asked))
    assert every == rows(evidence.governed_evidence(spark, SF))
    assert every != rows(hits), "field order"
    assert rows(hits) != rows(retrieval.retrieve(asked, facts, chunks, 5, as_of=now, synonyms=False)), "synonyms"
    assert rows(hits) != rows(retrieval.retrieve(asked, facts, chunks, 5)), "staleness"
    assert rows(hits) != rows(retrieval.retrieve(asked, facts.withColumn("source_kind", F.lit("manual")), chunks, 5, as_of=now)), "reviews"
    assert rows(hits) != rows(retrieval.retrieve(asked, facts, chunks, 5, as_of=now, alpha=0.0)), "affinity"
