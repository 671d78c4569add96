"""MinHash near-duplicates with min-max hashing."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergence.llm.common import NEAR_PERCENT, SHINGLE_WORDS, Scratch, cut, sized_broadcast
from vergence.llm.components import extended
from vergence.llm.nearlinks import similarity_components

#: A pair at 75 % similarity shares no band of 28 in one case of two thousand, one at 80 % in one of 70,000.
BANDS, BAND_VALUES = 28, 5
_KEPT_WORDS = 500_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: dict, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: words are runs of all but ASCII white space,
    with A-Z in lower case; fewer words than the width make one shingle; none make none."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    total = np.full(n, min(width, len(h)), np.uint64)
    for i in range(min(width, len(h))):
        total = total * _FACTOR + h[i : i + n]
    return np.unique(_mix(total))


@functools.cache
def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, (count, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, (count, 1), dtype=np.uint32)


def min_max_signature(members: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """Of each of `count` permutations of the 32-bit numbers, the least and then the greatest image."""
    factor, shift = _permutations(count, seed)
    low, high = np.full(count, 0xFFFFFFFF, np.uint32), np.zeros(count, np.uint32)
    x = (members >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        image = x[i : i + 1024] * factor
        image += shift
        np.minimum(low, image.min(axis=1), out=low)
        np.maximum(high, image.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, bands: int, values: int) -> np.ndarray:
    """A 64-bit key of each band; the band's number is part of it."""
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in signature[: bands * values].reshape(bands, values).T:
        key = _mix(key * _FACTOR + column)
    return key.view(np.int64)


def sketches(docs: DataFrame, bands: int = BANDS, values: int = BAND_VALUES) -> DataFrame:
    """(doc_id, of_text, n, class_a, class_b, keys) of documents (doc_id, of_text, text): set size, two hashes of the whole set, band keys."""
    count = -(-bands * values // 2)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                m = shingle_set(text, words)
                keys = band_keys(min_max_signature(m, count), bands, values) if len(m) else np.empty(0, np.int64)
                rows.append((len(m), xxhash.xxh64_intdigest(m.tobytes(), 1) - (1 << 63), xxhash.xxh64_intdigest(m.tobytes(), 2) - (1 << 63), keys))
            yield pdf[["doc_id", "of_text"]].join(pd.DataFrame(rows, columns=["n", "class_a", "class_b", "keys"], index=pdf.index))

    return docs.mapInPandas(sketch, "doc_id long, of_text long, n int, class_a long, class_b long, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, members) of documents (id, text)."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "members": [shingle_set(t, words).view(np.int64) for t in pdf["text"]]})

    return docs.mapInPandas(sets, "id long, members array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = NEAR_PERCENT, bands: int = BANDS, values: int = BAND_VALUES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs.

    Sets with one band key in common are candidates; links are confirmed on the full sets.  Equal
    sets are one class from the start, and only its least id goes on.  A null or wordless text has
    an empty set and links with nothing.  Rows that repeat an id are one document: each has its
    own text's n_shingles, all share the component that their texts lead to, and all are kept if
    that is the id's own.  A null id stands alone with a null component and is kept.  A very long
    text's set is held by one task.  Other columns are ignored; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("of_text"), F.col(text_col).alias("text"))
    marks = scratch.table(sketches(texts, bands, values))
    filled = marks.where("n > 0 and doc_id is not null")
    classes = filled.groupBy("class_a", "class_b", "n").agg(F.min("doc_id").alias("rep"), F.min_by("of_text", "doc_id").alias("of_rep"))
    classes = scratch.table(classes.withColumn("id", F.monotonically_increasing_id()))
    reps = classes.select("id", F.col("rep").alias("doc_id"), F.col("of_rep").alias("of_text"), "class_a", "class_b")
    rows = filled.join(reps, ["doc_id", "of_text", "class_a", "class_b"]).select(F.explode("keys").alias("key"), "id", "n")

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = cut(classes.join(ids, "id", "left_semi").select("id", F.col("rep").alias("doc_id"), F.col("of_rep").alias("of_text")))
        asked = sized_broadcast(asked, asked.count())  # texts don't move for up to a million sets
        return shingle_sets(texts.join(asked, ["doc_id", "of_text"]).select("id", "text")).dropDuplicates(["id"])

    found = similarity_components(rows, sets_of, percent)
    # the texts of a repeated id belong together
    own = filled.select("doc_id", "class_a", "class_b", "n").distinct()
    repeated = own.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1")
    of_id = own.join(repeated, "doc_id").join(classes.select("class_a", "class_b", "n", "id"), ["class_a", "class_b", "n"]).select("doc_id", "id")
    joined = cut(of_id.join(of_id.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("id <> a").select("a", F.col("id").alias("b")))
    if not joined.isEmpty():
        found = extended(found, joined)
    of_class = classes.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = scratch.table(of_class.join(least, "component").select("class_a", "class_b", "n", "component_id"))
    out = marks.drop("keys").join(of_class, ["class_a", "class_b", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
