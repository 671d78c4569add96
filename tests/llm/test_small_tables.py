"""Small tables between large steps are few tasks and few files, whatever number of partitions the session's shuffles have."""

from pathlib import Path

import pytest

from vergence.llm import components, lines

SHUFFLED = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in SHUFFLED}
    for k, v in SHUFFLED.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_of_few_edges_are_few_files(spark, many_partitions):
    held = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    parts = lambda: {p for p in held.rglob("part-*") if "rdd-" in str(p)}
    before = parts()
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    found = components.connected_components(chain)
    assert dict(map(tuple, found.collect())) == {i: 0 for i in range(1, 301)} | {1001: 1000}
    assert found.rdd.getNumPartitions() <= 2
    more = components.extended(found, spark.createDataFrame([(300, 1001)], "a long, b long"))
    assert dict(map(tuple, more.collect())) == {i: 0 for i in [*range(1, 301), 1000, 1001]}
    # the edges as they come, twice, are all that is dealt over the shuffle's partitions
    assert len(parts() - before) <= 2 * 64 + 32


def test_a_text_is_split_once_for_all_its_lines(spark):
    many = [f"line {i} of one text is like no other {i * i} here" for i in range(300)]
    docs = spark.createDataFrame([(1, "\n".join([*many, many[7], "tail"])), (2, many[9]), (None, many[3] + "\nleft"), (3, None)], "doc_id long, text string")
    found = lines.dedup_lines(docs, percent=100, least_words=lines.EVERY_LINE)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = {r["doc_id"]: (r["text"], r["line_count"], r["removed_lines"]) for r in found.collect()}
    assert got == {1: ("\n".join([*many, "tail"]), 302, 1), 2: ("", 1, 1), None: ("left", 2, 1), 3: (None, 0, 0)}
