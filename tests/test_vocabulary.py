"""Token spans, unknown stretches, the top-k index and the purity of quotes."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vergence.functions import text
from vergence.operators import ranking, retrieval, routing, topk, vocabulary

ODD = ["", "雀巢咖啡的配料", "Nutella, Ferrero怎么样", "so1002到 哪", "保 温,杯", "的", "茶", "a茶b", "１２é x9", "有没有Kindle Paperwhite 4", "，。！"]


def spans(s):
    out = []
    for m in re.finditer("[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", s):
        if re.match("[A-Za-z0-9]", m[0]):
            out.append((m[0].lower(), m.start(), len(m[0])))
            continue
        c = [(x, m.start() + i) for i, x in enumerate(m[0]) if x.isalnum()]
        found = [(x + y, p, q - p + 1) for (x, p), (y, q) in zip(c, c[1:])] if len(c) > 1 else [(x, p, 1) for x, p in c]
        out += [f for f in found if not set(f[0]) & set(text.STOP_CHARS)]
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 ,的有没保温杯咖啡é，"), max_size=14), min_size=1, max_size=25))
def test_spans_have_the_tokens(spark, texts):
    texts = texts + ODD
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for i, found, tokens in frame.select("i", vocabulary.token_spans(F.col("t")), text.tokens(F.col("t"))).collect():
        assert [tuple(x) for x in found] == spans(texts[i]) and [x["token"] for x in found] == tokens


def test_longest_stretches(spark):
    rng = random.Random(2)
    rows = [(q, rng.randrange(30), rng.randrange(1, 6)) for q in range(60) for _ in range(rng.randrange(1, 9))]
    want = {}
    for q in {r[0] for r in rows}:
        covered = {p for x, s, n in rows if x == q for p in range(s, s + n)}
        runs = [(s, next(n for n in range(1, 40) if s + n not in covered)) for s in covered if s - 1 not in covered]
        want[q] = min(runs, key=lambda r: (-r[1], r[0]))
    got = vocabulary.longest_stretches(spark.createDataFrame(rows, "query_id long, start int, length int")).collect()
    assert {r["query_id"]: (r["start"], r["length"]) for r in got} == want


def judged(spark, questions, chunks, titles, **k):
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
    held = spark.createDataFrame([(i, 1, 0, c) for i, c in enumerate(chunks)], "asset_id long, version_no int, seq int, chunk string")
    titled = spark.createDataFrame(list(enumerate(titles)), "asset_id long, title string")
    return {r["query_id"]: (r["entity"], r["start"]) for r in vocabulary.oov_verdicts(asked, titled, held, **k).collect()}


def test_verdicts(spark):
    chunks = ["花生酱香浓", "净含量：340克", "退货政策见说明", "冰淇淋 Vanilla", *(f"行{i}号货品" for i in range(100))]
    titles = ["钛钢保温杯", "花生酱 资料", None]
    questions = [
        "雀巢咖啡的配料是什么",  # four characters that no chunk has
        "Nutella, Ferrero怎么样",  # a comma parts names; opinion words aren't looked at
        "钛钢保温杯戴森吸尘器",  # a title is named, so no verdict
        "净含量",  # only the name of a field
        "花生酱香浓",  # all known
        "华为手",  # too short
        "vanilla Häagen",  # letters of any alphabet stand side by side
        "",
    ]
    got = judged(spark, questions, chunks, titles)
    assert got == {0: ("雀巢咖啡", 0), 1: ("Nutella", 0), 6: ("Häagen", 8)}
    assert judged(spark, questions, chunks[:20], titles) == {}
    assert judged(spark, [None, "   "], chunks, titles) == {}


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_index_gives_the_rows_of_the_join(spark, block):
    """Blocks are skipped, ties stand by key, and no row is lost."""
    rng = random.Random(block)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    some = lambda n: " ".join(words[min(int(rng.expovariate(0.15)), len(words) - 1)] for _ in range(n))
    chunks = spark.createDataFrame([(i // 3, i % 3, some(rng.randrange(0, 12))) for i in range(600)] + [(900, 0, None)], "asset_id long, seq int, chunk string").repartition(3)
    asked = spark.createDataFrame([(i, some(rng.randrange(0, 6))) for i in range(40)] + [(50, None), (None, "waa"), (51, "unknown")], "query_id long, question string")
    key = ["asset_id", "seq"]
    want = retrieval.top_k(retrieval.lexical_scores(asked.where("query_id is not null"), chunks, key), 4, *key).select("query_id", "rank", *key, "overlap", "score")
    got = topk.lexical_top_k(asked, chunks, key, 4, block_rows=block).select("query_id", "rank", *key, "overlap", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_index_skips_blocks():
    import numpy as np

    index = topk.Index([(1, "a"), (1, "b"), (2, "c")])
    best = [topk._Best(1, 1) for _ in index.ids]
    block = lambda rows, terms, sizes, keys: index.block(np.array(rows), np.array(terms), np.array(sizes), np.array([keys]), best)
    assert block([0, 0], [0, 1], [2], [7]) == 1  # the second question shares no term
    assert block([0, 1], [0, 1], [9, 9], [1, 2]) == 0  # at most 2 / sqrt(9), below 2 / sqrt(2)
    assert block([0, 0], [0, 1], [2], [3]) == 1 and best[0].key.tolist() == [[3]]


def test_few_rows_are_exchanged(spark):
    """Tasks hand on k rows of a question at most, however many chunks share its terms."""
    chunks = spark.createDataFrame([(i, 0, f"same word w{i}") for i in range(4000)], "asset_id long, seq int, chunk string").repartition(2)
    asked = spark.createDataFrame([(1, "same word"), (2, "word")], "query_id long, question string")
    found = topk.lexical_top_k(asked, chunks, ["asset_id", "seq"], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert [tuple(r)[:3] for r in found.select("query_id", "rank", "asset_id").orderBy("query_id", "rank").collect()] == [(q, r, r - 1) for q in (1, 2) for r in (1, 2, 3)]


def test_quotes_are_pure(spark):
    products = spark.createDataFrame([(1, "钛钢保温杯", "杯壶", 9900, "CNY"), (2, "紫砂壶", "杯壶", 19900, "CNY"), (3, "无价品", "杂项", None, "CNY")], "id long, name string, category string, price_cents long, currency string")
    questions = ["钛钢保温杯多少钱", "钛钢保温杯刻字怎么收费", "保温杯多少钱", "杯壶怎么卖", "杯壶的保养收费吗", "无价品多少钱", "请问钛钢保温杯多少钱一个", "钛钢保温杯多少钱，包邮吗"]
    asked = spark.createDataFrame([(i, q, 3 if "无价" in q else 1, "无价品" if "无价" in q else "钛钢保温杯") for i, q in enumerate(questions)], "query_id long, question string, product_id long, name string")
    got = {r["query_id"]: (r["kind"], r["quote"]) for r in routing.quotes(asked, products, routing.category_array(products)).collect()}
    assert got == {0: ("product", "99元"), 1: ("none", None), 2: ("product", "99元"), 3: ("category", "99元–199元"), 4: ("none", None), 5: ("none", None), 6: ("product", "99元"), 7: ("none", None)}


def test_terms_of_texts_are_those_of_their_chunks(spark):
    rng = random.Random(5)
    pieces = ["ab", "Q", "x", "7", "42", "é", "É", "保温杯", "茶", "的", " ", " ", "，", "。", "；", "\n", ":", "净含量：", ",", "k9", "\x1f", "a" * 30, "长" * 30, "-"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(150)] + ["x", "7，8。x y", "茶。" + "z" * 41 + "，v，w", None, ""]
    bodies = spark.createDataFrame([(t,) for t in texts], "body string").repartition(3)
    chunks = retrieval.chunks_of(bodies)
    every = {r["term"] for r in retrieval.postings(chunks, []).collect()}
    names = sorted(every | {t + "q" for t in every if t.isascii()} | {"v", "w", "z", "8", "杯茶", "长保", "éx", "é茶", "0", "b"})
    frame = spark.createDataFrame([(t,) for t in names], "term string")
    assert not re.search(retrieval._hold_any({"茶", "杯茶"}).replace("\\x{", "\\u").replace("}", ""), "café " * 3)
    for limits in ((2000, 64), (2000, 1), (3, 64)):
        retrieval.ODD_TERMS, retrieval.FIRST_TEXTS, held = *limits, (retrieval.ODD_TERMS, retrieval.FIRST_TEXTS)
        try:
            got = [r["term"] for r in retrieval.known_terms(frame, bodies).collect()]
        finally:
            retrieval.ODD_TERMS, retrieval.FIRST_TEXTS = held
        assert sorted(got) == sorted(every & set(names)), limits
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*names, "保温杯 ab 42", "nowhere x 茶长", None, "", "ab", "ab"])], "query_id long, question string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(retrieval.unknown_terms(asked, chunks, bodies)) == rows(retrieval.unknown_terms(asked, chunks))
    assert rows(ranking.without_evidence(asked, chunks, bodies)) == rows(ranking.without_evidence(asked, chunks))
    assert rows(ranking.unknown_words(asked, chunks, corpus=1, texts=bodies)) == rows(ranking.unknown_words(asked, chunks, corpus=1))
    titled = spark.createDataFrame([("茶 zz",)], "title string")
    assert rows(vocabulary.oov_verdicts(asked, titled, chunks, least=1, corpus=1, texts=bodies)) == rows(vocabulary.oov_verdicts(asked, titled, chunks, least=1, corpus=1))
    assert {r[0] for r in ranking.field_terms(bodies).collect()} == {r[0] for r in ranking.field_terms(chunks).collect()}


def test_questions_of_one_id_are_judged_as_one(spark):
    asked = spark.createDataFrame([(0, "ab zzzz"), (0, "xxxxxx"), (1, "ab zzzz"), (2, "ab zzzz")], "query_id long, question string")
    bodies = spark.createDataFrame([("ab cd",)], "body string")
    titled = spark.createDataFrame([("cd",)], "title string")
    got = vocabulary.oov_verdicts(asked, titled, retrieval.chunks_of(bodies), corpus=1, texts=bodies).collect()
    assert sorted(map(tuple, got)) == [(0, "ab zzzz", 0), (0, "xxxxxx", 0), (1, "zzzz", 3), (2, "zzzz", 3)]
