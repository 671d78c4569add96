"""The inverted-file index against brute force."""

import numpy as np

from vergence.operators import retrieval, vector_index


def _crowded(n, dim=24, seed=5):
    """A third of all rows around one centre, the others around twenty more."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(21, dim))
    of = np.where(np.arange(n) % 3 == 0, 0, 1 + rng.integers(0, 20, n))
    return centres[of] + 0.6 * rng.normal(size=(n, dim))


def _frame(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


def _exact(vectors, ids, k, floor):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = {}
    for q in ids:
        cos = unit @ unit[q]
        best = np.lexsort((np.arange(len(cos)), -cos))[:k]
        found[q] = [int(i) for i in best if cos[i] >= floor]
    return found


def _by_query(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    return found


def test_recall_on_a_crowded_table(spark):
    x = _crowded(3000)
    vectors = _frame(spark, x)
    asked = vectors.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding as query")
    centroids = vector_index.fit(vectors, sample=1000).cache()
    index = vector_index.build(vectors, centroids).cache()
    assert index.count() == 3000
    probes, lists = centroids.selectExpr("max(probes)", "count(*)").first()
    assert probes < lists
    exact = _exact(x, range(0, 3000, 50), 10, 0.0)
    got = _by_query(vector_index.search(asked, index, centroids, 10, 0.0))
    hits = sum(len(set(exact[q]) & set(got.get(q, []))) for q in exact)
    assert hits / sum(map(len, exact.values())) >= 0.95
    every = vector_index.search(asked, index, centroids, 10, 0.0, probes=lists, block=100)  # lists in many blocks
    assert _by_query(every) == exact
    r = vector_index.recall(every, retrieval.nearest(asked, vectors, 10, 0.0)).first()
    assert (r["expected"], r["recall"]) == (600, 1.0)


def test_unusable_vectors_lengths_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, float("nan")]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (8, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centroids = vector_index.fit(vectors)
    index = vector_index.build(vectors, centroids)
    assert sorted(r["vec_id"] for r in index.collect()) == [0, 1, 7]
    found = vector_index.search(vectors.selectExpr("vec_id as query_id", "embedding as query"), index, centroids, 10, 0.6)
    assert _by_query(found) == {0: [0, 1], 1: [0, 1], 7: [7]}
    none = vectors.where("vec_id = 3")
    assert vector_index.search(none.selectExpr("vec_id as query_id", "embedding as query"), vector_index.build(none, vector_index.fit(none)), vector_index.fit(none)).count() == 0


def test_gate_comes_after_the_cut(spark):
    found = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2), (2, 5, 0.9, 1), (3, 7, 0.9, 1)], "query_id long, vec_id long, cos double, rank int")
    asked = spark.createDataFrame([(1, "物流到哪了"), (2, "物流快不快"), (3, None)], "query_id long, question string")
    kinds = spark.createDataFrame([(5, "review_import"), (6, "manual")], "vec_id long, source_kind string")
    got = sorted((r["query_id"], r["vec_id"], r["rank"]) for r in vector_index.gated(found, asked, kinds).collect())
    assert got == [(1, 6, 2), (2, 5, 1), (3, 7, 1)]


def test_exact_way_holds_few_blocks_of_queries(spark):
    x = _crowded(120)
    vectors = _frame(spark, x)
    asked = vectors.selectExpr("vec_id as query_id", "embedding as query")
    found = retrieval.nearest(asked, vectors, 5, 0.0, block=9)  # fourteen blocks
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 4
    assert _by_query(found) == _exact(x, range(120), 5, 0.0)
