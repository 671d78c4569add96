"""Products and categories that questions name, against plain definitions."""

import random

from vergence.operators import matching

ROWS = "id long, name string, category string, stock int, price_cents long, currency string"


def _longest(a, b):
    best = (0, 0)
    for i in range(len(a)):
        n = best[0] + 1
        while i + n <= len(a) and a[i : i + n] in b:
            best, n = (n, i), n + 1
    return best


def test_longest_piece_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc茶杯") for _ in range(n))
    names = [(i, word(rng.randint(1, 9)), "k", 1, 1, "CNY") for i in range(40)] + [(40, None, "k", 1, 1, "CNY"), (41, "", "k", 1, 1, "CNY"), (42, "茶" * 200, "k", 1, 1, "CNY")]
    asked = [(i, word(rng.randint(0, 14))) for i in range(60)] + [(60, None), (61, ""), (62, "xyz"), (63, "x" * 900 + "茶" * 150)]
    got = {r["query_id"]: (r["product_id"], r["piece"]) for r in matching.matched_products(spark.createDataFrame(asked, "query_id long, question string"), spark.createDataFrame(names, ROWS)).collect()}
    plain = {}
    for i, q in asked:
        found = [(-n, pid, at) for pid, name, *_ in names for n, at in [_longest(q or "", name or "")] if n >= 2]
        if found:
            n, pid, at = min(found)
            plain[i] = (pid, q[at : at - n])
    assert got == plain and got[63] == (42, "茶" * 150)


def _products(spark):
    return spark.createDataFrame([
        (1, "钛钢保温杯", "器皿", 42, 9900, "CNY"), (2, "紫砂壶", "器皿", 0, 19950, "CNY"), (3, "WANDS 家具（演示）", "家具", 5, 89900, "CNY"), (4, "无价品", "杂项", None, None, "CNY"),
        (5, "美元壶", "外币", 1, 500, "USD"), (6, "外币碗", "外币", 1, 700, "CNY"), (7, "欧元灯", "灯具", 1, 1230, "eur"), (8, "吊灯架", "灯具", 2, None, None),
    ], ROWS)


def _asked(spark, questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")


def _answers(df):
    return {r["query_id"]: (r["kind"], r["product_id"], r["answer"]) for r in df.collect()}


def test_quotes_answer_only_what_is_asked(spark):
    aliases = spark.createDataFrame([(0, "杯子", "器皿"), (1, "没有的", "没有的类目")], "place int, token string, category string")
    questions = ["保温杯多少钱", "钛钢保温杯刻字怎么收费", "器皿多少钱", "杯子多少钱", "家具多少钱", "家具送货安装怎么收费", "无价品多少钱", "外币多少钱", "美元壶多少钱", "灯具贵不贵", "没有的多少钱", None]
    got = _answers(matching.quote_answers(_asked(spark, questions), _products(spark), aliases))
    both = ("category", None, "器皿共 2 件，其中已定价 2 件，价格 99元–199.5元；问具体型号给你准确价。")
    none = ("none", None, None)
    assert got == {
        0: ("product", 1, "钛钢保温杯（器皿）售价 99元。"), 1: none, 2: both, 3: both, 4: ("category", None, "家具共 1 件，其中已定价 1 件，均为 899元；问具体型号给你准确价。"), 5: none, 6: none,
        7: ("product", 6, "外币碗（外币）售价 7元。"),  # no span of two currencies; the name that shares most is quoted
        8: ("product", 5, "美元壶（外币）售价 5 USD。"), 9: ("category", None, "灯具共 2 件，其中已定价 1 件，均为 12.3 EUR（另有 1 件未定价）；问具体型号给你准确价。"), 10: none, 11: none,
    }


def test_stocks_answer_only_what_is_asked(spark):
    questions = ["你们有家具吗", "保温杯有货吗", "保温杯卖完了还能刻字吗", "紫砂壶有货吗", "无价品有货吗", "器皿壳有货吗", "杂项还有货吗"]
    got = _answers(matching.stock_lookups(_asked(spark, questions), _products(spark)))
    none = ("none", None, "没有找到对应商品，已转人工。")
    assert got == {
        0: ("category", None, "家具共 1 件，其中有货 1 件，库存合计 5 件。"), 1: ("in_stock", 1, "钛钢保温杯有货，当前库存 42 件。"), 2: none, 3: ("out_of_stock", 2, "紫砂壶暂时无货。"),
        4: ("unset", 4, "无价品库存未设置，已转人工。"), 5: none, 6: ("category", None, "杂项共 1 件，其中有货 0 件（库存未逐件设置）。"),
    }


def test_no_catalog(spark):
    empty = spark.createDataFrame([], ROWS)
    assert matching.matched_products(_asked(spark, ["保温杯"]), empty).count() == 0
    assert _answers(matching.quote_answers(_asked(spark, ["保温杯多少钱"]), empty)) == {0: ("none", None, None)}


def test_questions_never_meet_all_names_that_share_a_piece(spark):
    names = spark.createDataFrame([(i, f"同名{i}", "k", 1, 1, "CNY") for i in range(300)], ROWS)
    found = matching.matched_products(_asked(spark, ["同名"] * 300), names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert {r["product_id"] for r in found.collect()} == {0}
