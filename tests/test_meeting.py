"""Questions met inside tasks give the rows of the joins, and no pair of a question and a chunk is exchanged."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vergence.functions.text import masked
from vergence.operators import meeting, ranking, retrieval, sweep
from vergence.plans import evidence, more, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=[3, 10_000])
def batch_rows(spark, request):
    """Batches that end inside an asset, and whole ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _tables(spark, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)] + ["快递", "a.bc@x.org", "abcd@x.org", "13912345678", "13812345678"]
    some = lambda n: " ".join(words[min(int(rng.expovariate(0.12)), len(words) - 1)] for _ in range(n))
    lines = [some(rng.randrange(0, 5)) for _ in range(25)] + ["call 13912345678", "call 13912345678", "call 13512340078 waa", None]
    chunks = spark.createDataFrame([(a, v, s, rng.choice(lines)) for a in range(60) for v in (1, 2) for s in range(rng.randrange(0, 12))], "asset_id long, version_no int, seq int, chunk string").repartition(3)
    kinds = ["manual", retrieval.REVIEWS, None]
    assets = spark.createDataFrame([(a, rng.choice([some(3), "", None]), rng.choice(kinds), rng.choice(["2023-01-01 00:00:00", "2024-01-30 00:00:00", None])) for a in range(55)], "asset_id long, title string, source_kind string, at string").withColumn("verified_at", F.col("at").cast("timestamp"))
    texts = [some(rng.randrange(0, 5)) for _ in range(20)] + ["物流怎么样", "快递 waa", "call 13912345678", "", None]
    asked = spark.createDataFrame([(i, rng.choice(texts)) for i in range(60)], "query_id long, question string")
    return asked, assets, chunks


@pytest.mark.parametrize("seed", [1, 2])
def test_retrieve_gives_the_rows_of_the_joins(spark, batch_rows, seed, monkeypatch):
    asked, assets, chunks = _tables(spark, seed)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    marked = chunks.withColumn("same", F.xxhash64(masked(F.col("chunk"))))
    key = ["query_id", "rank", "asset_id", "version_no", "seq", "score"]
    for synonyms in (False, True):
        want = retrieval._joined_hits(asked.where("question is not null"), assets, marked, 4, now, 3.0, synonyms).select(*key).collect()
        for rows in (2048, 2):
            monkeypatch.setattr(meeting, "BLOCK_ROWS", rows)
            got = retrieval.retrieve(asked, assets, chunks, 4, now, synonyms=synonyms)
            assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, retrieval.retrieve(asked, assets, chunks, 4, now).select(*key).collect())) == sorted(map(tuple, want))


def test_affinity_and_overlaps_give_the_rows_of_the_joins(spark, batch_rows, monkeypatch):
    asked, assets, chunks = _tables(spark, 3)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    affinity = rows(retrieval.title_affinity(asked, assets))
    assert affinity and affinity == rows(retrieval._joined_affinity(asked, assets))
    best, found = rows(retrieval.title_top_k(asked, assets, 3)), rows(retrieval.best_overlaps(asked, chunks, 2))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert best == rows(retrieval.title_top_k(asked, assets, 3)) and found == rows(retrieval.best_overlaps(asked, chunks, 2))


@pytest.mark.parametrize("query", [registry.retrieve_top_k, more.evidence_anchors, more.gaps_resolved, more.weak_evidence, evidence.governed_evidence], ids=lambda q: q.__name__)
def test_pairs_are_not_exchanged(spark, query):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert "Aggregate [query_id#" not in plan.split("MapInArrow")[-1], "scores of pairs are summed after a join"


def test_coverage_holders_and_extremes_give_the_rows_of_the_joins(spark, batch_rows, monkeypatch):
    asked, assets, chunks = _tables(spark, 4)
    bodies = chunks.where("version_no = 1 and seq = 2").select("asset_id", F.col("chunk").alias("body")).join(assets.select("asset_id", "title"), "asset_id")
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    lexical, affinity = retrieval.lexical_scores(asked, bodies.select("asset_id", F.col("body").alias("chunk")), ["asset_id"]), retrieval._joined_affinity(asked, bodies)
    none = spark.createDataFrame([], "query_id long, asset_id long, cos double")
    every = rows(sweep.swept(lexical, affinity, none, sweep.LEVELS, "asset_id"))
    few = {r["asset_id"] for r in retrieval.extreme_assets(asked, bodies, 3, (0.0, 3.0)).collect()}
    kept = lambda df: df.where(F.col("asset_id").isin(few))
    assert every == rows(sweep.swept(kept(lexical), kept(affinity), none, sweep.LEVELS, "asset_id"))
    found = [rows(retrieval.coverage_top_k(asked, chunks, "asset_id", 3).select("query_id", "asset_id", "rank", "coverage")), rows(retrieval.expected_assets(asked, bodies))]
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert found == [rows(retrieval.coverage_top_k(asked, chunks, "asset_id", 3).select("query_id", "asset_id", "rank", "coverage")), rows(retrieval.expected_assets(asked, bodies))]


def test_a_task_hands_on_k_vectors_of_a_query():
    """However many batches it reads."""
    held = type("Held", (), {"value": {2: (np.array([7]), np.array([[1.0, 0.0]]))}})()
    batch = lambda at: pd.DataFrame({"vec_id": range(at, at + 50), "embedding": [np.array([1.0, 0.0])] * 50})
    out = pd.concat(retrieval._hits([held], 3, 0.5)(iter([batch(100), batch(0), batch(50)])))
    assert out["vec_id"].tolist() == [0, 1, 2]


def test_ranked_targets_give_the_rows_of_the_join(spark, monkeypatch):
    _, _, chunks = _tables(spark, 5)
    probes = spark.createDataFrame([(i, f"waa wb{c} x", "waa", t) for i, (c, t) in enumerate([("a", "wac"), ("b", "wbc"), ("c", "waa"), ("d", "快递 wab"), ("e", "none")])], "query_id long, question string, span string, target string")
    found = ranking.ranked_targets(probes, chunks, ["asset_id", "version_no", "seq"])
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 0)
    assert rows and rows == sorted(map(tuple, ranking.ranked_targets(probes, chunks, ["asset_id", "version_no", "seq"]).collect()))


def test_many_wordings_lose_terms_that_nothing_has_and_meet_chunks_in_blocks(spark, batch_rows, monkeypatch):
    asked, assets, chunks = _tables(spark, 6)
    orders = [(100 + i, f"so-{9000 + i}到哪了") for i in range(40)] + [(200 + i, f"so-{9000 + i} waa wbb 运费") for i in range(5)]
    asked = asked.unionByName(spark.createDataFrame([*orders, (300, "物流 zzz"), (301, "物流 zzz 怎么样")], "query_id long, question string"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    key = ["query_id", "rank", "asset_id", "version_no", "seq", "score"]
    every = lambda synonyms: retrieval.retrieve(asked, assets, chunks, 4, now, synonyms=synonyms).select(*key)
    want = [sorted(map(tuple, every(synonyms).collect())) for synonyms in (True, False)]
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(retrieval, "_joined_hits", None)  # pairs of a question and a chunk are exchanged there
    for terms in (500_000, 10):
        monkeypatch.setattr(retrieval, "BLOCK_TERMS", terms)
        assert want == [sorted(map(tuple, every(synonyms).collect())) for synonyms in (True, False)]
    few = every(True)
    few.collect()
    plan = few._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    assert plan.count("MapInArrow best") > 1 and plan.count("MapInArrow number") == 1, "chunks are exchanged once for all blocks"
    nobody = retrieval.retrieve(asked.where("query_id between 100 and 139"), assets, chunks, 4, now)
    assert nobody.count() == 0
