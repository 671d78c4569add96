"""Views of assets and sessions, tickets, summaries and maps on literal rows."""

from pyspark.sql import functions as F

from vergence.functions import fields
from vergence.functions.text import masked
from vergence.operators import governance, sessions


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_backflow(spark):
    data = [(1, 1, "customer", None), (2, 1, "agent", "refusal"), (3, 1, "customer", None), (4, 1, "agent", "answer"), (5, 2, "customer", None), (6, 2, "agent", "handoff"), (7, 1, "agent", "refusal")]
    m = spark.createDataFrame(data, "id long, session_id long, role string, kind string")
    assert [r["id"] for r in sessions.kept_for_backflow(m).orderBy("id").collect()] == [3, 4, 5]


def test_tickets_and_subjects(spark):
    asks = spark.createDataFrame([(7, 1, "help", None), (9, 1, "again", "abc"), (12345, 2, "x", "y"), (12346, 2, "z", None)], "id long, session_id long, message string, contact string")
    assert rows(sessions.one_ticket(asks)) == [(1, "H-0007", "help", "abc"), (2, "H-12345", "x", "y")]
    tools = spark.createDataFrame([(1, 1, ("catalog", "杯")), (2, 1, ("get_stock", "-")), (3, 1, ("other", "z"))], "id long, session_id long, tool struct<name: string, arg: string>")
    assert rows(sessions.last_tool_subject(tools)) == [(1, "杯")]
    q = spark.createDataFrame([("它的材质", "保温杯"), ("价格", "杯"), ("它", None)], "q string, p string")
    assert [r[0] for r in q.select(sessions.expanded_question(F.col("q"), F.col("p"))).collect()] == ["保温杯 它的材质", "价格", "它"]
    pool = lambda x: spark.createDataFrame(x, "question string, n int")
    assert rows(sessions.larger_pool(pool([("a", 1), ("b", 5)]), pool([("a", 3)]))) == [("a", 3), ("b", 5)]


def test_assets(spark):
    versions = spark.createDataFrame([(1, 1, 10, "d"), (1, 2, 11, None), (2, 1, 20, None), (2, 2, 21, None)], "asset_id int, version_no int, version_id int, published_at string")
    assets = spark.createDataFrame([(1, "a", 5, 10), (2, "b", None, None)], "asset_id int, title string, product_id int, current_version_id int")
    products = spark.createDataFrame([(5, "cup")], "product_id int, name string")
    assert rows(governance.current_version(assets, versions)) == [(1, 1), (2, 1)]
    assert rows(governance.asset_list(assets, versions, products)) == [(1, "a", "cup", 1, True), (2, "b", None, None, False)]
    assert [[tuple(v) for v in r["versions"]] for r in governance.asset_detail(assets, versions).orderBy("asset_id").collect()] == [[(1, True), (2, False)], [(1, False), (2, False)]]


def test_summaries(spark):
    v = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "k string, supported boolean")
    assert rows(governance.judge_summary(v, ["k"])) == [("a", 2, 1, 1, 0.5), ("b", 0, 0, 0, None)]
    hit = lambda x: spark.createDataFrame(x, "c int, hit boolean")
    assert rows(governance.level_changes(hit([(1, False), (2, True), (3, True)]), hit([(1, True), (2, False), (3, True)]), "c")) == [("gained", 1), ("kept", 1), ("lost", 1)]
    calls = spark.createDataFrame([("m", 3, 4), ("m", 1, None), ("m", 2, 2)], "model string, prompt_tokens int, completion_tokens int")
    assert rows(governance.usage_totals(calls)) == [("m", "completion", 6), ("m", "prompt", 5)]
    hits = spark.createDataFrame([(1, 2, 8, 1, "「B」", "x  y"), (1, 1, 7, 2, "A", "abc@x.co")], "query_id int, rank int, asset_id int, version_no int, title string, chunk string")
    assert governance.evidence_lines(hits).first()["evidence"] == "[A-7·v2] A：****@x.co\n[A-8·v1] B：x y"
    b = governance.batches(spark.range(5).withColumn("k", F.lit(1)), "k", "id", 2)
    assert [r["batch"] for r in b.orderBy("id").collect()] == [0, 0, 1, 1, 2]
    labelled = spark.range(3).select(governance.first_matching_rule([(F.col("id") > 1, "big"), (F.col("id") > 0, "mid")], F.lit("none")))
    assert [r[0] for r in labelled.collect()] == ["none", "mid", "big"]


def test_maps(spark):
    df = spark.createDataFrame([({"a": ("1",), "b": (" ",)}, {"x": "abc@x.co"}, [{"phone": "1", "item": "13812345678"}])], "c map<string, struct<value: string>>, m map<string, string>, o array<map<string, string>>")
    r = df.select(fields.inherited(F.col("c")).alias("i"), fields.with_key(F.col("m"), "y", F.lit("2")).alias("w"), fields.without_contacts(F.col("o"), masked).alias("o")).first()
    assert ({k: tuple(v) for k, v in r["i"].items()}, r["w"], r["o"]) == ({"a": ("1", True)}, {"x": "abc@x.co", "y": "2"}, [{"item": "1********78"}])
