"""Text quality by naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their counts in the two classes, and a linear
model with hinge loss is fitted to them by dual coordinate descent, on blocks of a bounded sample
of labelled rows whose weights are averaged.  Rows kept apart turn the margin into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergence.llm.common import cut, sized_broadcast

#: Most labelled rows that the model is fitted on, and the blocks that they are fitted in; one more block calibrates.
SAMPLE_ROWS, BLOCKS = 20_000, 5
#: Feature slots, passes of the descent, and the loss's weight.
SLOTS_BITS, EPOCHS, COST = 18, 12, 1.0
SLOTS = 1 << SLOTS_BITS
_PIECE, _KEPT = 1 << 20, 300_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash and shape of words: case, digits, marks, and how long."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= _KEPT:
            self.clear()
        letters = "".join(filter(str.isalpha, word))
        case = 0 if not letters else 1 if letters.islower() else 2 if letters.istitle() else 3 if letters.isupper() else 4
        marks = len(word) - sum(map(str.isalnum, word))
        shape = case + 5 * any(map(str.isdigit, word)) + 10 * min(marks, 3) + 40 * min(len(word) // 8, 3)
        self[word] = found = (xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass")), shape + 1)
        return found


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _FACTOR
    h ^= h >> np.uint64(32)
    return (h * _FACTOR) >> np.uint64(64 - SLOTS_BITS)


def _ngrams(x: np.ndarray, size: int) -> np.ndarray:
    n = len(x) - size + 1
    h = np.zeros(max(0, n), np.uint64)
    for i in range(size if n > 0 else 0):
        h = (h + x[i : i + n]) * _FACTOR
    return h


def features(text: str | None, words: dict) -> np.ndarray:
    """The distinct slots of the text's n-grams: characters by 1 and 3, words by 1 and 2, shapes of words by 1, 2 and 3."""
    text, found, at = text or "", [], 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        if end < len(text) and (space := text.rfind(" ", at, end)) > at:
            end = space
        part, at = text[at:end], end
        x = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pairs = [words[w] for w in part.split()]
        h = np.array([p[0] for p in pairs], np.uint64)
        shape = np.array([p[1] for p in pairs], np.uint64)
        if len(h) > 1:
            shape[1:] += np.uint64(1000) * (h[1:] == h[:-1])  # the same word again
        grams = [(x, 1), (x, 3), (h, 1), (h, 2), (shape, 1), (shape, 2), (shape, 3)]
        found.append(np.unique(np.concatenate([_slots(_ngrams(v, size), kind) for kind, (v, size) in enumerate(grams)])))
    return (np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.empty(0, np.uint64)).astype(np.int32)


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, slots: np.ndarray) -> float:
        r = self.ratios[slots]
        norm = math.sqrt(float(r @ r))
        return float(r @ self.weights[slots]) / norm + self.bias if norm else self.bias

    def score(self, slots: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.margin(slots) + self.shift))))


def descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, epochs: int, cost: float, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model by dual coordinate descent; both classes count alike."""
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    values = [ratios[s].astype(np.float64) for s in rows]
    values = [v / (math.sqrt(float(v @ v)) or 1.0) for v in values]
    square = [float(v @ v) + 1.0 for v in values]  # the bias is a feature that is always 1
    positive = max(1, int((y > 0).sum()))
    most = np.where(y > 0, len(y) / (2 * positive), len(y) / (2 * max(1, len(y) - positive))) * cost
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(values[i] @ w[rows[i]]) + bias) - 1
            step = min(max(alpha[i] - gradient / square[i], 0.0), most[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps, with the targets of Platt's method."""
    up, down = int((y > 0).sum()), int((y < 0).sum())
    if not up or not down:
        return 1.0, 0.0
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, at = np.c_[margins, np.ones(len(margins))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * at)
        at += step
        if np.abs(step).max() < 1e-7:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of docs with label, of at most about sample_rows labelled rows by their hash; no document moves for it."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1))
    rate = max(1, math.ceil(known.count() / sample_rows))
    some = cut(known.where(F.pmod(F.xxhash64(F.lit("label"), id_col), F.lit(rate)) == 0))
    return docs.drop("label").join(sized_broadcast(some, some.count()), id_col)


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "label", sample_rows: int = SAMPLE_ROWS, blocks: int = BLOCKS, epochs: int = EPOCHS, cost: float = COST) -> Model:
    """The model of labelled rows (label 1 or 0; other and null labels are passed over), at most about sample_rows of them by their hash.

    With a single class, or without rows, every text has the margin of the bias alone."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").withColumn("place", F.xxhash64("text", "label"))
    rate = max(1, math.ceil(rows.count() / sample_rows))
    some = rows.where(F.pmod("place", F.lit(rate)) == 0).withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks + 1)).cast("int"))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for pdf in batches:
            yield pd.DataFrame({"block": pdf["block"], "label": pdf["label"], "slots": [features(t, words) for t in pdf["text"]]})

    sample = cut(some.select("block", "label", "text").mapInPandas(slots, "block int, label int, slots array<int>"))
    training, apart = sample.where(F.col("block") < blocks), sample.where(F.col("block") == blocks)
    counted = training.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    counts = counted.toArrow().to_pandas()  # SLOTS rows at most
    p, q = np.ones(SLOTS), np.ones(SLOTS)
    p[counts["slot"]] += counts["p"]
    q[counts["slot"]] += counts["q"]
    ratios = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
    shared = sample.sparkSession.sparkContext.broadcast(ratios)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        w, bias = descend([np.asarray(s, np.int64) for s in pdf["slots"]], np.where(pdf["label"] > 0, 1.0, -1.0), shared.value, epochs, cost)
        at = np.flatnonzero(w)
        return pd.DataFrame({"n": [len(pdf)], "bias": [bias], "slots": [at], "weights": [w[at]]})

    parts = training.groupBy("block").applyInPandas(fitted, "n long, bias double, slots array<int>, weights array<double>").collect()  # one row for each block
    model, total = Model(ratios, np.zeros(SLOTS, np.float32), 0.0), sum(r["n"] for r in parts)
    for r in parts:
        model.weights[r["slots"]] += np.asarray(r["weights"], np.float32) * (r["n"] / total)
        model.bias += r["bias"] * r["n"] / total
    whole = sample.sparkSession.sparkContext.broadcast(model)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"margin": [whole.value.margin(np.asarray(x, np.int64)) for x in pdf["slots"]], "label": pdf["label"]})

    held = apart.select("slots", "label").mapInPandas(margins, "margin double, label int").collect()  # sample_rows / (blocks + 1) rows
    if held:
        model.slope, model.shift = _calibrated(np.array([r["margin"] for r in held]), np.array([1.0 if r["label"] else -1.0 for r in held]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of docs with score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5) after them.

    Whole texts are read; a null or empty text has no n-grams and the score of the bias.  Columns
    of docs with these names are replaced; repeated rows are rows like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, m = _Words(), shared.value
        for texts in batches:
            yield pd.Series([m.score(features(t, words)) for t in texts], dtype="float64")

    return docs.drop("score", "predicted").withColumn("score", scores(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
