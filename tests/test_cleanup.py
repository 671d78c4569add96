"""Ordered clean-up, numbers over whole tables and batches."""

import random

import pytest
from pyspark.sql import functions as F

from vergence.operators import cleanup, numbering

LINKS = [cleanup.Link("c", "b_id", "b"), cleanup.Link("b", "a_id", "a")]


def chain(spark):
    rng = random.Random(1)
    a = [(i, i % 4 == 0) for i in range(40)]
    b = [(i, rng.choice([None, *range(45)]), i % 11 == 0) for i in range(150)]
    c = [(i, rng.choice([None, *range(160)]), i % 17 == 0) for i in range(500)]
    frames = (spark.createDataFrame(a, "a long, bad boolean"), spark.createDataFrame(b, "b long, a_id long, bad boolean"), spark.createDataFrame(c, "c long, b_id long, bad boolean"))
    return (a, b, c), {n: (df, n) for n, df in zip("abc", frames)}


def test_cleanup_leaves_no_orphan(spark):
    (a, b, c), tables = chain(spark)
    kept = spark.createDataFrame([(0,), (8,)], "k long")
    gone = cleanup.removals(tables, {n: F.col("bad") for n in "abc"}, LINKS, {"a": kept})
    of_a = {i for i, bad in a if bad} - {0, 8}
    of_b = {i for i, up, bad in b if bad or up in of_a}
    of_c = {i for i, up, bad in c if bad or up in of_b}
    assert list(gone) == ["c", "b", "a"]  # children first
    assert [{r[0] for r in gone[n].collect()} for n in "abc"] == [of_a, of_b, of_c]
    report = {r["name"]: (r["before"], r["removed"], r["after"], r["orphans"]) for r in cleanup.cleanup_report(tables, LINKS, gone).collect()}
    assert report == {n: (len(t), len(g), len(t) - len(g), 0) for n, t, g in zip("abc", (a, b, c), (of_a, of_b, of_c))}
    left = cleanup.applied(tables, gone)
    again = cleanup.removals({n: (left[n], n) for n in "abc"}, {n: F.col("bad") for n in "abc"}, LINKS, {"a": kept})
    assert all(again[n].count() == 0 for n in "abc")


def test_cycles_are_refused(spark):
    with pytest.raises(ValueError):
        cleanup.levels(["a", "b"], [cleanup.Link("a", "x", "b"), cleanup.Link("b", "y", "a")])


def test_numbers_without_a_single_task(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(30), *[7] * 20]), rng.random()) for i in range(700)]
    frame = spark.createDataFrame(rows, "id long, v int, w double").repartition(5)
    found = numbering.numbered(frame, F.col("v"), F.desc("w"), F.col("id"), ranges=8)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[2], r[0]))]
    assert [r["id"] for r in sorted(found.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in found.collect()) == list(range(1, 701))
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert numbering.numbered(frame.where("false"), F.col("v")).count() == 0


def test_batches_go_on_where_they_stopped(spark):
    items = spark.createDataFrame([(i,) for i in [*range(200), 5, 5, None]], "id long")
    good, short, odd = [0.5] * 4, [0.5] * 3, [0.5, float("nan"), 1.0, 2.0]
    ledger = [(1, good), (2, short), (3, odd), (4, None), (6, [None, 1.0, 1.0, 1.0])]
    rounds = 0
    while True:
        due = numbering.embedding_batches(items, spark.createDataFrame(ledger, "id long, embedding array<double>"), "id", dimensions=4).collect()
        if not due:
            break
        if not rounds:
            assert {r["id"] for r in due} == set(range(200)) - {1}
        sizes = [sum(r["batch"] == b for r in due) for b in sorted({r["batch"] for r in due})]
        assert max(sizes) <= 64 and all(n == 64 for n in sizes[:-1])
        first = [r["id"] for r in due if r["batch"] <= 1]  # the run is lost after two batches
        ledger += [(i, good) for i in first]
        rounds += 1
    assert rounds == 2
