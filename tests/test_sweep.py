"""Configurations from one set of hits."""

from vergence.operators import sweep


def test_levels(spark):
    frame = lambda rows, last: spark.createDataFrame(rows, f"query_id long, asset_id long, {last} double")
    lexical = frame([(1, 10, 0.9), (1, 11, 0.5), (1, 12, 0.1), (2, 20, 0.4)], "score")
    affinity = frame([(1, 11, 1.0), (1, 99, 1.0)], "affinity")
    dense = frame([(1, 12, 0.95), (1, 13, 0.99), (3, 30, 0.9)], "cos")
    configurations = (*sweep.LEVELS, sweep.Configuration("dense", 0.0, 10.0))
    ranked = sweep.swept(lexical, affinity, dense, configurations, "asset_id").cache()
    of = {}
    for r in ranked.orderBy("rank").collect():
        of.setdefault((r["configuration"], r["query_id"]), []).append((r["asset_id"], r["final"]))
    assert of["L1", 1] == [(10, 0.9), (11, 0.5), (12, 0.1)]
    assert of["L2", 1] == [(11, 2.0), (10, 0.9), (12, 0.1)]
    assert of["L3", 1] == [(11, 1.0), (13, 0.495), (12, 0.475)]  # 10 has (0.9 - 0.1) / (2.0 - 0.1), below both
    assert [a for a, _ in of["dense", 1]] == [13, 12, 10] and of["L3", 2] == [(20, 1.0)]
    assert not any(q == 3 for _, q in of)  # dense hits alone don't answer
    cases = spark.createDataFrame([(1, 11, "a"), (2, 20, "a"), (3, None, "b")], "query_id long, expected long, case_group string")
    got = {(r["configuration"], r["case_group"]): (r["n"], r["recall_1"], r["recall_3"]) for r in sweep.sweep_metrics(cases, ranked, configurations).collect()}
    assert got["L1", "a"] == (2, 0.5, 1.0) and got["L2", "a"] == (2, 1.0, 1.0) and got["L3", "overall"] == (3, 0.6667, 0.6667) and got["dense", "b"] == (1, 0.0, 0.0)
    assert [tuple(r) for r in sweep.changes(ranked, "L1", "L2").collect()] == [(1, 2, 1, 11)]
    assert [tuple(r) for r in sweep.changes(ranked, "L1", "dense").collect()] == [(1, None, 1, 13)]
