"""Stateful and vector operators against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from vergence.operators import audit, evaluation, limits, retrieval, sessions, stats
from vergence.plans import registry


def test_limiter(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        rows.append((i, rng.randrange(5), rng.randrange(3000)))
    df = spark.createDataFrame(rows, "id long, k long, at long").withColumn("ts", F.timestamp_seconds("at"))
    got = {r["id"]: (r["admitted"], r["retry_after"]) for r in limits.limited(df, "k", "ts", "id", 3, 600.0).collect()}
    held: dict = {}
    for i, k, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        held[k] = [t for t in held.get(k, []) if t > at - 600]
        if len(held[k]) < 3:
            held[k].append(at)
            assert got[i] == (True, 0)
        else:
            assert got[i] == (False, max(1, math.ceil(600 - (at - held[k][0]))))


def test_segments_restart_their_span(spark):
    rows = [(1, 0.0, 5.0), (1, 5.5, 21.0), (1, 21.5, 22.0), (1, 30.0, 31.0), (2, 0.0, 1.0)]
    got = limits.segments(spark.createDataFrame(rows, "k long, s double, e double"), "k", "s", "e").orderBy("key", "segment").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0.0, 21.0, 2), (1, 1, 21.5, 22.0, 1), (1, 2, 30.0, 31.0, 1), (2, 0, 0.0, 1.0, 1)]
    assert limits.segments(spark.createDataFrame([], "k long, s double, e double"), "k", "s", "e").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got: dict = {}
    for r in retrieval.nearest(asked, df, 5, 0.2, block=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(10):
        cos = u @ u[q]
        best = [i for i in np.argsort(-cos)[:5] if cos[i] >= 0.2]
        assert [v for _, v in sorted(got[q])] == best


def test_memory_skips_unanswered(spark):
    rows = [(1, 7, 0, "customer", "a"), (2, 7, 1, "customer", "b"), (3, 7, 2, "agent", "c"), (4, 7, 3, "agent", "d"), (5, 8, 0, "agent", "e")]
    m = spark.createDataFrame(rows, "id long, session_id long, turn int, role string, content string")
    assert [tuple(r) for r in sessions.recent_turns(m).collect()] == [(7, 1, 2, 3)]
    assert {tuple(r) for r in sessions.previous_question(m).collect()} == {(3, 7, "b"), (4, 7, "b"), (5, 8, None)}
    assert {tuple(r) for r in sessions.next_reply(m).collect()} == {(1, 7, 3), (2, 7, 3)}
    assert sessions.transcript(m).where("session_id = 7").first()["transcript"] == "顾客：a\n顾客：b\n客服：c\n客服：d"


def test_satisfaction_without_ratings(spark):
    got = stats.satisfaction(spark.createDataFrame([(9,)], "score int"), "score").orderBy("score").collect()
    assert [(r["score"], r["n"], r["average"]) for r in got] == [(i, 0, None) for i in range(1, 6)]


def test_metrics(spark):
    cases = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30)], "query_id long, case_group string, expected long")
    ranked = spark.createDataFrame([(1, 10, 1), (2, 9, 1), (2, 20, 2)], "query_id long, asset_id long, rank int")
    got = {r["case_group"]: r for r in evaluation.metrics(evaluation.judged(cases, ranked)).collect()}
    assert (got["a"]["recall_1"], got["a"]["recall_3"], got["a"]["mrr"]) == (0.5, 1.0, 0.75)
    assert got["b"]["noise_3"] == 1.0 and got["overall"]["n"] == 3


def test_search_all_words_in_any_field(spark):
    rows = spark.createDataFrame([(1, "Red Ring", "shop"), (2, "red", None), (3, None, None)], "i int, a string, b string")
    assert [r["i"] for r in audit.search(rows, " red SHOP ", ["a", "b"]).collect()] == [1]
    assert audit.search(rows, "", ["a"]).count() == 3


def test_letter_share_of_odd_texts(spark, tmp_path):
    """An empty text has no share, and ties are rounded as doubles are, both as the SQL does."""
    texts = ["", None, "ab é", "ÃÂ©x", "   ", "a" * 41 + " " * 599, "a" + " " * 127]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["mojibake"], str(r["letter_share"])) for r in registry.odd_texts(spark, str(tmp_path)).collect()}
    assert got == {0: (False, "nan"), 1: (None, "None"), 2: (False, "0.5"), 3: (True, "0.25"), 4: (False, "0.0"), 5: (False, "0.064062"), 6: (False, "0.007813")}


def test_training_pairs_of_a_long_conversation(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "assistant", f"w{t}") for c, n in ((1, 2_600), (2, 4), (3, 3)) for t in range(1, n + 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["asset_id"]: (r["n"], r["chars"]) for r in registry.training_pairs(spark, str(tmp_path)).collect()}
    chars = lambda n: sum(len(f"w{t}") for t in range(1, n + 1))
    assert got == {1: (1_300, chars(2_600)), 2: (2, chars(4)), 3: (1, chars(2))}
