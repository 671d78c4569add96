"""Publishing in batches: verdicts, new states, repeated and lost runs."""

import pytest
from pyspark.sql import functions as F

from vergence.operators import publish
from vergence.sources.snapshots import Snapshots

AT = "2024-02-01 00:00:00"
ASSET = "asset_id long, product_id long, kind string, status string, current_version_id long, discarded_at timestamp, verified_at timestamp"
VERSION = "version_id long, asset_id long, version_no int, published_at timestamp, body string, pairs array<struct<q:string,a:string>>, extracted map<string,struct<value:string,abstained:boolean>>, confirmed map<string,struct<value:string>>"
OLD = "timestamp '2024-01-01'"


def state(spark):
    frame = spark.createDataFrame
    got, none = (lambda **f: {k: (v, False) for k, v in f.items()}), {}
    said = lambda **f: {k: (v,) for k, v in f.items()}
    assets = [
        (1, 9, "document", "pending_review", None, None, None), (2, 9, "document", "pending_review", None, None, None), (3, 9, "document", "published", 31, None, None), (4, 9, "document", "published", 41, None, None),
        (5, None, "document", "pending_review", None, None, None), (6, 9, "image", "pending_review", None, None, None), (7, None, "video", "pending_review", None, None, None), (8, 9, "document", "draft", None, None, None),
        (10, None, "document", "pending_review", None, None, None), (11, 9, "document", "pending_review", None, None, None), (12, 77, "document", "pending_review", None, None, None),
    ]
    versions = [
        (11, 1, 1, None, "保修一年。包邮发货", [("能洗吗", "可以")], none, said(net="5克", note="好")), (21, 2, 1, None, "x", None, got(net="5克"), none), (31, 3, 1, None, "旧文本", None, none, said(net="1克")), (32, 3, 2, None, "新文本", None, none, said(net="3克")),
        (41, 4, 1, None, "旧", None, none, said(net="4克")), (51, 5, 1, None, "没有产品", None, none, none), (61, 6, 1, None, None, None, none, {"图片描述": ("红色杯子",), "net": ("6克",)}),
        (71, 7, 1, None, None, None, got(transcript="视频文本"), none), (81, 8, 1, None, "x", None, none, none), (101, 10, 1, None, None, None, none, none), (111, 11, 1, None, "x", None, {"net": (" ", False)}, none), (121, 12, 1, None, "产品未知", None, none, said(net="2克")),
    ]
    published_at = F.when(F.col("version_id").isin(31, 41), F.expr(OLD))
    return {
        "assets": frame(assets, ASSET), "versions": frame(versions, VERSION).withColumn("published_at", published_at),
        "products": frame([(9, {"net": (True,), "mail": (False,)})], "product_id long, schema map<string,struct<required:boolean>>"),
        "chunks": frame([(3, 1, 0, "旧文本"), (4, 1, 0, "旧")], "asset_id long, version_no int, seq int, chunk string"),
        "values": frame([(9, "net", "1克", 3, 1), (9, "mail", "a@b", 3, 1), (9, "size", "大", 4, 1), (8, "net", "z", 3, 1)], "product_id long, field string, value string, asset_id long, version_no int"),
        "audit": frame([], "asset_id long, version_no int, action string, at timestamp"),
        "gaps": frame([(1, "三包多久", 1, "open", None), (2, "zzz", 1, "open", None), (3, "保修", 2, "open", None), (4, "", 1, "open", None), (5, "保修", None, "open", None)], "gap_id long, question string, asset_id long, status string, resolved_at timestamp"),
    }


def asked(spark):
    return spark.createDataFrame([(i,) for i in [*range(1, 9), 10, 11, 12, 99, 1, None]], "asset_id long")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_verdicts_and_tables(spark):
    before = state(spark)
    decided = publish.verdicts(before, asked(spark)).checkpoint()
    found = {r["asset_id"]: r for r in decided.collect()}
    assert {k: r["verdict"] for k, r in found.items()} == {1: "published", 2: "gate", 3: "published", 4: "state", 5: "published", 6: "published", 7: "published", 8: "state", 10: "unreadable", 11: "gate", 12: "published", 99: "missing"}
    assert (found[2]["missing"], found[2]["unconfirmed"], found[11]["missing"]) == ([], ["net"], ["net"])
    after = publish.published(before, decided, AT)
    assert rows(after["assets"].where("status = 'published'"), "asset_id", "current_version_id") == [(1, 11), (12, 121), (3, 32), (4, 41), (5, 51), (6, 61), (7, 71)]
    assert after["versions"].where(f"published_at = timestamp '{AT}'").count() == after["audit"].count() == after["assets"].where("verified_at is not null").count() == 6
    assert rows(after["chunks"].where("asset_id in (1, 3, 6, 7)"), "asset_id", "version_no", "seq", "chunk") == sorted(
        [(1, 1, 0, "问：能洗吗 答：可以"), (1, 1, 1, "保修一年"), (1, 1, 2, "包邮发货"), (1, 1, 3, "net：5克"), (1, 1, 4, "note：好"), (3, 1, 0, "旧文本"), (3, 2, 0, "新文本"), (3, 2, 1, "net：3克"), (6, 1, 0, "红色杯子"), (6, 1, 1, "net：6克"), (7, 1, 0, "视频文本")], key=str)
    # the last asset writes net, asset 3 gives up its mail, asset 4 wasn't published and keeps its own
    assert rows(after["values"], "product_id", "field", "value", "asset_id") == [(8, "net", "z", 3), (9, "net", "6克", 6), (9, "size", "大", 4)]
    assert rows(after["gaps"], "gap_id", "status") == [(1, "resolved"), (2, "open"), (3, "open"), (4, "open"), (5, "open")]


def test_a_second_run_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    first = Snapshots(spark, root)
    for name, df in state(spark).items():
        first.stage(name, df)
    first.commit()
    publish.publish_batch(spark, root, asked(spark), AT)
    once = Snapshots(spark, root)
    assert once.number == 2
    again = publish.publish_batch(spark, root, asked(spark), "2024-03-01 00:00:00")
    assert again.where("verdict = 'published'").isEmpty()
    twice = Snapshots(spark, root)
    assert twice.number == 2
    for name, df in once.current().items():
        assert rows(df, *df.columns) == rows(twice.current()[name], *df.columns)


def test_a_lost_run_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    first = Snapshots(spark, root)
    assert first.current() == {}
    for name, df in state(spark).items():
        first.stage(name, df)
    first.commit()

    def lost(self, name, df, stage=Snapshots.stage):
        if name == "values":
            raise RuntimeError("lost")
        return stage(self, name, df)

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "stage", lost)
        with pytest.raises(RuntimeError):
            publish.publish_batch(spark, root, asked(spark), AT)
    kept = Snapshots(spark, root).current()
    assert kept["audit"].count() == 0 and rows(kept["chunks"], "asset_id", "chunk") == [(3, "旧文本"), (4, "旧")]
    publish.publish_batch(spark, root, asked(spark), AT)  # and the run can be repeated
    assert Snapshots(spark, root).current()["audit"].count() == 6


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one, two = Snapshots(spark, root), Snapshots(spark, root)
    one.stage("t", spark.range(1))
    two.stage("t", spark.range(2))
    one.commit()
    with pytest.raises(Exception, match="exist"):
        two.commit()
    assert Snapshots(spark, root).current()["t"].count() == 1


def test_empty_tables(spark):
    empty = {name: df.where("false") for name, df in state(spark).items()}
    decided = publish.verdicts(empty, asked(spark)).checkpoint()
    assert {r["verdict"] for r in decided.collect()} == {"missing"}
    assert all(df.count() == 0 for df in publish.published(empty, decided, AT).values())
