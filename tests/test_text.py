"""Text functions on literal rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vergence.functions import text


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "value, tokens",
    [
        ("so1002", ["so", "1002"]),
        ("Nutella, Ferrero", ["nutella", "ferrero"]),
        ("保温杯400g", ["保温", "温杯", "400", "g"]),
        ("保，温", ["保温"]),
        ("的", []),
        ("杯", ["杯"]),
        ("杯的盖", []),
        ("", []),
        (" ,. ", []),
        ("éon", ["é", "on"]),
    ],
)
def test_tokens(spark, value, tokens):
    assert one(spark, text.tokens, value) == tokens


def test_tokens_of_null(spark):
    assert one(spark, text.tokens, None) is None


def test_chunks(spark):
    body = "净含量：550毫升，保温\n\n短句。a\n" + "很长的一句话" * 7 + "，后半句也不短。尾"
    assert one(spark, text.document_chunks, body) == ["净含量：550毫升，保温", "短句", "很长的一句话" * 7, "后半句也不短"]
    assert len(one(spark, text.document_chunks, "一二三。" * 300)) == 300
    assert len(one(spark, lambda x: text.document_chunks(x, 200), "一二三。" * 300)) == 200
    assert one(spark, text.document_chunks, "甲乙\u3000\r丙丁\x0b\u3000戊己") == ["甲乙", "丙丁", "戊己"]
    assert one(spark, text.dialogue_chunks, "顾客：好\n\n a \n客服：好") == ["顾客：好", "客服：好"]


@pytest.mark.parametrize(
    "value, masked",
    [
        ("call 13812345678 now", "call 1********78 now"),
        ("订单1234567890123456", "订单1234567890123456"),
        ("ab@x.co abc@x.co", "ab@x.co ****@x.co"),
        ("13812345678@mail.com", "****@mail.com"),
    ],
)
def test_masked(spark, value, masked):
    assert one(spark, text.masked, value) == masked
    assert one(spark, text.masked, masked) == masked


@pytest.mark.parametrize("value, masked", [("138-0013-8000", "1********00"), ("ab@x.co", "****@x.co"), ("12 34", "12 34"), ("tel 010 1234567 ok 5", "tel 0*******67 ok 5"), ("", "")])
def test_contact_masked(spark, value, masked):
    assert one(spark, text.contact_masked, value) == masked


@pytest.mark.parametrize("value, key", [("  多少钱？？", "多少钱"), ("a，b。", "a,b"), ("？", ""), ("x (y)", "x (y)")])
def test_question_key(spark, value, key):
    assert one(spark, text.question_key, value) == key


@pytest.mark.parametrize("value, turned", [("保修", "质保"), ("三包多久", "保修多久"), ("折扣券", "优惠券"), ("给修吗", "保修吗"), ("无", "无")])
def test_synonyms(spark, value, turned):
    assert one(spark, text.rotated_synonyms, value) == turned


def test_prices(spark):
    rows = spark.createDataFrame([(1290, "CNY"), (1200, None), (None, "CNY"), (999, "usd"), (0, "CNY")], "c long, u string")
    assert [r[0] for r in rows.select(text.price_label(F.col("c"), F.col("u"))).collect()] == ["12.9元", "12元", "价格未定", "9.99 USD", "0元"]


def test_order_number(spark):
    assert one(spark, text.order_number, "so-1001 和 SO-2") == "SO-1001"
    assert one(spark, text.order_number, "SO-") is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", max_size=8), st.text("abcd", max_size=8)), min_size=1, max_size=20))
def test_longest_common(spark, pairs):
    def plain(a, b):
        return next((a[i : i + k] for k in range(len(a), 0, -1) for i in range(len(a) - k + 1) if a[i : i + k] in b), "")

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    found = dict(df.select("i", text.longest_common(F.col("a"), F.col("b"))).collect())
    assert found == {i: plain(a, b) for i, (a, b) in enumerate(pairs)}
