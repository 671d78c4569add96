"""Governance, field maps, labels, files and streams on literal rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from vergence.functions import fields, labels
from vergence.operators import governance
from vergence.sources import files
from vergence.streaming import limiter


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_actions_merge_by_strength(spark):
    data = [(1, "a", "keep", "old"), (2, "a", "fix", "typo"), (3, "a", "fix", "typo twice"), (4, "a", "fix", "no brand"), (5, "b", "keep", "x"), (6, "b", "retire", "y")]
    got = governance.merged_actions(spark.createDataFrame(data, "at int, ref string, action string, reason string"))
    assert rows(got) == [("a", "fix", "typo；no brand"), ("b", "retire", "y")]


def test_id_ranges(spark):
    df = spark.createDataFrame([("h", i) for i in (2, 3, 4, 7, 12345)], "k string, id long")
    assert governance.id_ranges(df, "k", "id", "H").first()["ranges"] == "H-0002–H-0004、H-0007、H-12345"


def test_published_view_and_rollback(spark):
    versions = spark.createDataFrame([(1, 1, 10, "2024"), (1, 2, 11, "2024"), (2, 1, 20, "2024"), (2, 2, 21, None)], "asset_id int, version_no int, version_id int, published_at string")
    assets = spark.createDataFrame([(1, "published", None, 11), (2, "published", "2024", 20)], "asset_id int, status string, discarded_at string, current_version_id int")
    chunks = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "gone")], "asset_id int, version_no int, chunk string")
    assert [r["chunk"] for r in governance.published_view(chunks, versions, assets).collect()] == ["new"]
    target = spark.createDataFrame([(1, 1), (2, 1)], "asset_id int, version_no int")
    assert [(r["asset_id"], r["current_version_id"]) for r in governance.rolled_back(versions, assets, target).collect()] == [(1, 10)]


def test_triage_and_steps(spark):
    votes = spark.createDataFrame([(False, [(1,), (None,)]), (True, [(2,)]), (None, [(3,)])], "helpful boolean, citations array<struct<asset_id: int>>")
    assets = spark.createDataFrame([(i, "t", "2024") for i in (1, 2, 3)], "asset_id int, title string, verified_at string")
    assert rows(governance.triaged(assets, votes).select("asset_id", "verified_at")) == [(1, None), (2, "2024"), (3, "2024")]
    assert rows(governance.down_voted(votes, assets)) == [(1, 1, "t")]
    steps = spark.createDataFrame([([("a", "done"), ("b", "pending")],), ([("a", "failed"), ("b", "pending")],), ([("a", "done")],)], "s array<struct<name: string, status: string>>")
    assert [r[0] for r in steps.select(governance.next_step(F.col("s"))).collect()] == ["b", None, None]
    asked = spark.createDataFrame([(1,), (9,)], "asset_id int")
    assert rows(governance.retire_plan(asked, assets.withColumn("discarded_at", F.lit(None).cast("string")))) == [(1, "to_retire"), (9, "missing")]


def test_publish_gate(spark):
    schema = "s map<string, struct<required: boolean>>, e map<string, struct<value: string, abstained: boolean>>, c map<string, struct<value: string>>"
    data = [({"a": (True,), "b": (True,), "d": (True,), "x": (False,)}, {"b": ("1", False), "d": ("2", True)}, {"a": ("9",), "x": (" ",)})]
    r = spark.createDataFrame(data, schema).select(fields.publish_gate(F.col("s"), F.col("e"), F.col("c")).alias("g"), fields.publishable_values(F.col("s"), F.col("c")).alias("v"), fields.resolved_value(F.col("e"), F.col("c"), F.lit("b")).alias("r")).first()
    assert (sorted(r["g"]["missing"]), r["g"]["unconfirmed"], r["v"], r["r"]) == (["d"], ["b"], {"a": "9"}, "1")


def test_write_back(spark):
    data = [({"a": ("1", (7, 1)), "b": ("2", (8, 1))}, {"c": "3"})]
    df = spark.createDataFrame(data, "v map<string, struct<value: string, source: struct<asset_id: int, version: int>>>, f map<string, string>")
    got = df.select(fields.written_back(F.col("v"), F.lit(7), F.lit(2), F.col("f")).alias("w")).first()["w"]
    assert {k: (x["value"], tuple(x["source"])) for k, x in got.items()} == {"b": ("2", (8, 1)), "c": ("3", (7, 2))}


@pytest.mark.parametrize("value, seconds", [("01:02:03", 3723), ("00:60:00", None), ("1:2", None), ("", None)])
def test_timecodes(spark, value, seconds):
    assert spark.createDataFrame([(value,)], "x string").select(fields.timecode_seconds(F.col("x"))).first()[0] == seconds


def test_sample_points(spark):
    df = spark.createDataFrame([(10.0,), (0.0,), (100.0,)], "x double").select(fields.sample_points(F.col("x"), 3.0, 5).alias("p"))
    assert [r["p"] for r in df.collect()] == [[0.0, 3.0, 6.0, 9.0], [], [0.0, 20.0, 40.0, 60.0, 80.0]]


@pytest.mark.parametrize("question, intent", [("你们店里有什么商品？", "listing"), ("有什么优惠", None), ("水杯多少钱", "price"), ("净含量多少", None), ("这个多少", "price"), ("转人工 多少钱", None), ("有什么好看的", None)])
def test_intents(spark, question, intent):
    assert spark.createDataFrame([(question,)], "x string").select(labels.catalog_intent(F.col("x"))).first()[0] == intent


def test_scopes_returns_and_categories(spark):
    df = spark.createDataFrame([("有没有现货",), ("有没有冰箱",), ("你们卖水杯吗",), ("天气",)], "x string")
    assert [r[0] for r in df.select(labels.scope_kind(F.col("x"), F.contains("x", F.lit("水杯")))).collect()] == ["generic", "out_of_scope", "in_scope", "not_scope"]
    df = spark.createDataFrame([("SO-1 我想退货",), ("退货进度",), ("退货政策",)], "x string")
    assert [r[0] for r in df.select(labels.wants_return(F.col("x"))).collect()] == [True, False, False]
    df = spark.createDataFrame([("手机壳",), ("买电视机",), ("无",)], "x string")
    assert [r[0] for r in df.select(labels.category_target(F.col("x"), ["智能手机", "电视机"])).collect()] == ["智能手机", "电视机", None]
    df = spark.createDataFrame([("GET /a?token=abc&x=1 postgres://u:pw@h/db",)], "x string")
    assert df.select(labels.without_secrets(F.col("x"))).first()[0] == "GET /a?token=***&x=1 postgres://u:***@h/db"


def test_csv_import(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("﻿content, title \n body ,one\n,two\n\"a\nb\",\n , \n" + "x" * 200_001 + ",big\n", encoding="utf-8")
    df = files.read_csv(spark, str(path), ["title", "content"]).coalesce(1).withColumn("row", F.monotonically_increasing_id() + 1)
    got = [(r["row"], r["title"], r["reason"]) for r in files.import_report(df, "row").collect()]
    assert got == [(1, "one", None), (2, "two", "content empty"), (3, "", "title empty"), (4, "", "both empty"), (5, "big", "content too long")]
    with pytest.raises(ValueError, match="lacks body"):
        files.read_csv(spark, str(path), ["body"])


def test_nested_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"train": [{"convo_id": 1, "scenario": {"flow": "f", "subflow": "s"}, "original": [["customer", " hi "], ["action", "x"], ["agent", " "]]}], "dev": [], "test": [{"convo_id": 2, "scenario": {}, "original": [["agent", "yo"]]}]}))
    assert [(r["convo_id"], r["at"], r["text"]) for r in files.read_dialogues(spark, str(tmp_path / "d.json")).orderBy("split").collect()] == [(1, 0, "hi"), (2, 0, "yo")]
    cell = lambda v: {"value": v, "type": "literal"}
    bindings = [{"item": cell("http://e/Q1"), "itemLabel": cell("A"), "categoryLabel": cell("c")}, {"item": cell("http://e/Q2"), "itemLabel": cell("Q2"), "categoryLabel": cell("c")}, {"item": cell("http://e/Q3"), "itemLabel": cell("A"), "categoryLabel": cell("c")}, {"item": cell("http://e/Q4"), "itemLabel": cell("B")}]
    (tmp_path / "b.json").write_text(json.dumps({"results": {"bindings": bindings}}))
    assert rows(files.read_bindings(spark, str(tmp_path / "b.json"))) == [("A", "c", "Q1")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "good").write_bytes("é".encode())
    (tmp_path / "t" / "bad").write_bytes(b"\xff\xfe\xfa")
    assert [(r["text"], r["ok"]) for r in files.read_texts(spark, str(tmp_path / "t")).orderBy("ok").collect()] == [(None, False), ("é", True)]


def test_loads(spark, tmp_path):
    held = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    fresh = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert rows(files.missing_rows(fresh, held, ["k"])) == [(3, "z")]
    assert rows(files.filled_rows(held, fresh, ["k"], ["v"])) == [(1, "x"), (2, "b")]
    ratings = spark.createDataFrame([(1, 5, 10), (1, 3, 20), (2, 4, 5)], "s int, score int, at int")
    assert rows(files.latest(ratings, ["s"], F.col("at"))) == [(1, 3, 20, 10), (2, 4, 5, 5)]
    files.write_samples(spark.createDataFrame([("abc@x.co", "ok")], "instruction string, output string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["instruction"] == "****@x.co"


def _drain(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def test_streams_match_batches(spark, tmp_path):
    from vergence.operators.limits import limited

    at = datetime.datetime(2024, 1, 1)
    data = [(i, i % 3, at + datetime.timedelta(seconds=40 * i)) for i in range(60)]
    df = spark.createDataFrame(data, "id long, k long, ts timestamp").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    _drain(limiter.limited_stream(stream, "k", "ts", "id", 2, 300.0), "limited", "append")
    assert rows(spark.table("limited")) == rows(limited(df, "k", "ts", "id", 2, 300.0))
    _drain(limiter.windowed_counts(stream, "ts", {"n": F.col("k") == 0}, "10 minutes"), "counted", "append")
    assert all(n == 5 for _, n in rows(spark.table("counted")))
    changes = stream.select(F.lit("open").alias("from_status"), (F.col("k") % 2).cast("string").alias("to_status"))
    _drain(limiter.transitions(changes), "moved", "complete")
    assert rows(spark.table("moved")) == [("open", "0", 40), ("open", "1", 20)]
