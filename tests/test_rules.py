"""Rules over one row and material operators where a table has nulls, blanks or nothing; archives and exports."""

import zipfile

import pytest
from pyspark.sql import functions as F

from vergence.functions import rules, text
from vergence.operators import material
from vergence.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030"])
def test_zipped_csv(spark, tmp_path, encoding):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("readme.txt", "x")
        archive.writestr("in.CSV", "cat, review\n书, 很好 \n,\"a\nb\"\n".encode(encoding))
    got = files.read_zipped_csv(spark, str(tmp_path / "a.zip"), ["review", "cat"]).orderBy("at").collect()
    assert [tuple(r)[1:] for r in got] == [(0, "很好", "书"), (1, "a\nb", "")]


def test_csv_has_a_mark_and_is_read_back(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("é", 1)], "a string, b int").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa,b")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out"), ["a", "b"]).collect()] == [("é", "1")]


def test_large_import_is_turned_down(spark):
    rows = spark.range(201).select("id", F.lit("t").alias("title"), F.lit("c").alias("content"))
    with pytest.raises(ValueError, match="200"):
        files.import_report(rows, "id")
    assert files.import_report(rows.limit(200), "id").where("reason is null").count() == 200


def test_rules_of_nulls(spark):
    none = F.lit(None).cast("string")
    assert one(spark, rules.answer_path(none, F.lit(None).cast("boolean"), none, F.lit(None).cast("boolean"))) == "template"
    assert one(spark, rules.without_credentials(none)) is None
    assert one(spark, rules.text_faults(none, none, F.lit("n"))) == ["body", "title"]
    assert one(spark, rules.fields_to_extract(F.lit("document"), F.lit(None).cast("array<string>"))) == []
    assert one(spark, rules.evidence_sentence(F.lit("document"), none, F.lit("净重：5g"))) == "根据已发布的规格文档《未命名资产》，净重为5g。"
    assert one(spark, rules.proposal(F.lit("TOOL: t {broken}"), {"t": ("k", ".")})) == "rejected"
    assert one(spark, rules.dialogue_title(none, none, none)) == "ABCD 对话"


def test_spans_are_longest_first(spark):
    assert one(spark, rules.candidate_spans(F.lit("运费险的abc无线鼠标垫的长"))) == ["运费险", "运费", "费险", "无线鼠标", "线鼠标垫", "无线鼠", "线鼠标", "鼠标垫", "无线", "线鼠", "鼠标", "标垫"]
    assert one(spark, rules.candidate_spans(F.lit(""))) == []


def test_masked_fields_keep_odd_pairs(spark):
    entry = F.expr("map('f', named_struct('value', string(null), 'qa', array(named_struct('q', '13912345678', 'a', string(null)))))")
    got = one(spark, rules.masked_fields(entry, text.masked))["f"]
    assert (got["value"], got["qa"][0]["q"], got["qa"][0]["a"]) == (None, "13912345678", None)


def test_reference_image_falls_back_to_the_newest_draft(spark):
    assets = spark.createDataFrame([(1, 10, 99, None), (1, 11, None, None), (2, 12, 120, None), (2, 13, None, None), (3, 14, None, "x"), (4, 15, None, None)], "product_id int, asset_id int, pointer int, discarded_at string")
    versions = spark.createDataFrame([(110, 11, 1), (111, 11, 2), (120, 12, 1), (130, 13, 1)], "version_id int, asset_id int, version_no int")
    assert sorted(tuple(r) for r in material.reference_images(assets, versions).collect()) == [(1, 11, 111), (2, 12, 120)]
    assert material.reference_images(assets.limit(0), versions).count() == 0


def test_rebinding_all_pending(spark):
    rows = spark.createDataFrame([(1, "pending", None), (2, "pending", 5), (3, "registered", None)], "id int, status string, recording_id int")
    assert sorted(tuple(r) for r in material.rebound(rows, 9).select("id", "recording_id").collect()) == [(1, 9), (2, 9), (3, None)]
    assert sorted(tuple(r) for r in material.rebound(rows, 9, rows.limit(0)).select("id", "recording_id").collect()) == [(1, None), (2, 5), (3, None)]
