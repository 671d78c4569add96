"""Extractors and rerankers on literal rows."""

import pytest
from pyspark.sql import functions as F

from vergence.functions import extract
from vergence.operators import ranking


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("value, found", [("约 500 ml 装", "500ml"), ("1.5L", "1.5L"), ("无", None)])
def test_net_content(spark, value, found):
    assert one(spark, extract.net_content, value) == found


@pytest.mark.parametrize("value, found", [("生产日期：2023年5月1日，保质期12个月", "12个月"), ("生产日期 2023年", None), ("保质期 3 年", "3年")])
def test_shelf_life(spark, value, found):
    assert one(spark, extract.shelf_life, value) == found


@pytest.mark.parametrize("value, found", [("材质：304不锈钢，耐用", "304不锈钢"), ("材质为不详", None), ("杯身采用玻璃材质", "玻璃"), ("未标注材质牌号", None), ("是棉材质", "棉"), ("好用", None)])
def test_material(spark, value, found):
    assert one(spark, extract.material, value) == found


def test_texts(spark):
    assert one(spark, extract.unescaped, "a &lt;b&gt; &amp;amp; &#39;") == "a <b> &amp; '"
    assert one(spark, lambda c: extract.pieces(c, 3), "abcdefg") == ["abc", "def", "g"]
    assert one(spark, extract.pieces, "") == []
    assert one(spark, extract.title_subject, "保温杯（OFF） · 规格") == "保温杯"
    df = spark.createDataFrame([(["hello", "world", "你好", "ok"],)], "x array<string>")
    assert df.select(extract.joined_words(F.col("x"))).first()[0] == "hello world你好ok"
    r = spark.createDataFrame([("材质：棉，保质期2年",)], "x string").select(extract.facts(F.col("x")).alias("f")).first()["f"]
    assert {k: (v["value"], v["abstained"]) for k, v in r.items()} == {"净含量": (None, True), "保质期": ("2年", False), "材质": ("棉", False)}


def test_clean_products(spark):
    raw = [("1", " A &amp; B ", "500 g", None, None, None), ("1", "dup", "1 l", None, None, None), ("x", "n", "1 l", None, None, None), ("2", "", "1 l", None, None, None), ("3", "n", "many", None, None, None)]
    df = spark.createDataFrame(raw, "code string, product_name string, quantity string, brands string, ingredients_text string, countries_en string").coalesce(1)
    got = extract.clean_products(df).collect()
    assert [(r["code"], r["name"]) for r in got] == [("1", "A & B")]
    line = extract.clean_products(df).select(extract.spec_text({"条码": F.col("code"), "品牌": F.col("brands"), "净含量": F.col("quantity")})).first()[0]
    assert line == "条码：1\n净含量：500 g"


def test_field_directed(spark):
    hits = spark.createDataFrame([(1, 1, 7, "产品很好"), (1, 2, 8, "上市年份：1999"), (1, 3, 7, "上市年份：2009"), (2, 1, 7, "上市年份：2009")], "query_id int, rank int, asset_id int, chunk string")
    questions = spark.createDataFrame([(1, "哪年上市"), (2, "颜色")], "query_id int, question string")
    got = ranking.field_directed(hits, questions).where("query_id = 1").orderBy("rank").collect()
    assert [(r["asset_id"], r["chunk"]) for r in got] == [(7, "上市年份：2009"), (7, "产品很好"), (8, "上市年份：1999")]


def test_interleaved(spark):
    schema = "query_id int, asset_id int, rank int"
    hits, own = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], schema), spark.createDataFrame([(1, 11, 1), (1, 20, 2), (1, 21, 3), (1, 22, 4)], schema)
    assert [r["asset_id"] for r in ranking.interleaved(hits, own, ["asset_id"]).orderBy("rank").collect()] == [10, 20, 11, 21, 12]


def test_cascade(spark):
    lexical = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 1.0, 2), (2, 10, 0.5, 1), (2, 12, 0.4, 2)], "query_id int, asset_id int, score double, rank int")
    dense = spark.createDataFrame([(1, 99, 0.9), (2, 12, 0.8), (2, 13, 0.9), (3, 14, 0.7)], "query_id int, asset_id int, cos double")
    got = {}
    for r in ranking.cascade(lexical, dense, "asset_id", 2.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["asset_id"])
    assert got == {1: [10, 11], 2: [13, 12, 10], 3: [14]}


def test_the_first_of_equal_codes_stays(spark):
    rows = [(str(i % 7), "" if i < 7 else f"n{i}", "500 g", "b", "", "") for i in range(70)]
    df = spark.createDataFrame(rows, "code string, product_name string, quantity string, brands string, ingredients_text string, countries_en string")
    got = extract.clean_products(df).collect()
    assert {r["code"]: r["name"] for r in got} == {str(i % 7): f"n{i}" for i in range(7, 14)}  # those without a name don't count
