"""Disclaimers, bare marks and answers of nothing else."""

from pyspark.sql import functions as F

from vergence.operators import answers


def test_what_is_left_of_answers(spark):
    cases = {
        "签收后 7 天内可申请退货。[1][2] 具体退货操作证据未覆盖。": ("签收后 7 天内可申请退货。", True),
        "已发布证据未说明保修。[1][2]": ("", False),
        "[未覆盖]": ("", False),
        "无法确认。[1]": ("", False),
        "配料信息中不包含任何防腐剂。": ("配料信息中不包含任何防腐剂。", True),
        "无法提供比这更详细的信息。": ("无法提供比这更详细的信息。", False),
        "未覆盖保修信息": ("未覆盖保修信息", False),
        "无法提供价格。售价 99 元。": ("售价 99 元。", True),
        "": ("", False),
        "[1]。！": ("", False),
        None: (None, None),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "answer string")
    got = {r["answer"]: (r["kept"], r["closes"]) for r in rows.select("answer", answers.without_disclaimers(F.col("answer")).alias("kept"), answers.closes_gap(F.col("answer")).alias("closes")).collect()}
    got = {k: (v[0] if v[0] is None else v[0].replace("[1][2]", "").strip(), v[1]) for k, v in got.items()}
    assert got == cases
