"""n-grams against brute force, with and without the frequent pieces broadcast."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from vergence.operators import grams


def brute(texts, least):
    out = []
    for n in (2, 3, 4):
        df = Counter()
        for t in texts:
            df.update({r[i : i + n] for r in re.findall("[一-龥]+", t or "") for i in range(len(r) - n + 1)})
        out += [(n, g, k) for g, k in df.items() if k >= least]
    return sorted(out)


@pytest.mark.parametrize("most", [10**6, 0])
def test_grams_against_brute_force(spark, most):
    rng = random.Random(8)
    texts = ["".join(rng.choice("一二三四五六七 ，ab") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "一", "一二三四" * 5000, "一二三四", "一二三四"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    for least in (1, 5, 20):
        assert sorted(map(tuple, grams.gram_frequencies(frame, "t", least, most=most).collect())) == brute(texts, least)
    assert grams.gram_frequencies(frame.where("false"), "t", 1).count() == 0


def test_texts_of_several_blocks_and_far_letters(spark, monkeypatch):
    monkeypatch.setattr(grams, "LETTERS_HELD", 7)
    texts = ["", "A", "aB", "aBc", "aBcaBc", "é aBcd", "aB" * 30, "😀aBc😀", None] * 3
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    df = Counter((n, g) for t in texts for n, g in {(n, r[i : i + n]) for n in (2, 3, 4) for r in re.findall("[A-Za-z]+", t or "") for i in range(len(r) - n + 1)})
    for most in (10**6, 0):
        got = sorted(map(tuple, grams.gram_frequencies(frame, "t", 6, letters="[A-Za-z]", most=most).collect()))
        assert got == sorted((n, g, k) for (n, g), k in df.items() if k >= 6)
    count = grams._pieces(2, "[A-Za-z]", None)
    rows = [list(zip(b["gram"].to_pylist(), b["df"].to_pylist())) for b in count([pa.RecordBatch.from_pydict({"text": ["aBaB", "aB"]})])]
    assert rows == [[("Ba", 1), ("aB", 2)]]  # summed in the task
