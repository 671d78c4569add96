"""Benchmark decontamination by greedy string tiling.

Texts and items meet where they share a seed of a few words.  Of each such pair the longest common
runs are marked again and again, the longest first and none over another, found by running
Karp-Rabin hashes; the share of the item that tiles cover tells whether the text holds it, in any
order of its parts.  The items are a stated query set: they go to all tasks in blocks of bounded
size, and the texts are never moved.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergence.llm.common import SHINGLE_WORDS, stored

#: Words of a seed and of the shortest tile; share of an item from which a text is contaminated.
TILE_WORDS, COVERAGE = SHINGLE_WORDS, 0.5
#: Characters of items that go to the tasks at once.
BLOCK_CHARS = 8_000_000
_KEPT_WORDS = 500_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SIEVE_BITS = 22
_WORD = re.compile(r"\w+")
FOUND = "array<struct<item_id: bigint, coverage: double, tiles: array<struct<at: int, item_at: int, words: int>>>>"


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def tokens(text: str | None, words: dict) -> np.ndarray:
    """Hashes of the words (runs of letters, digits and underscores) in lower case."""
    found = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(words.__getitem__, found), np.uint64, len(found))


def window_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows."""
    n = max(0, len(x) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(size if n else 0):
        h = h * _FACTOR + x[i : i + n]
    return h


class _Running:
    """Hashes of windows of any size from one pass of powers and prefixes."""

    def __init__(self, x: np.ndarray, most: int):
        self.n, self.most = len(x), most
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(most, _FACTOR)])  # modulo 2 ** 64
        self.sums = np.r_[np.uint64(0), np.cumsum(x * self.power[: self.n])]

    def windows(self, size: int, marked: np.ndarray) -> list[tuple[int, int]]:
        """(hash, start) of the windows without a marked place."""
        if size > self.n:
            return []
        h = (self.sums[size:] - self.sums[: self.n - size + 1]) * self.power[self.most : self.most - self.n + size - 1 : -1]  # all to one power
        marks = np.r_[0, np.cumsum(marked)]
        free = np.flatnonzero(marks[size:] == marks[: self.n - size + 1])
        return list(zip(h[free].tolist(), free.tolist()))


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, words): longest first, of equal ones the leftmost, none over another."""
    in_text, in_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    most = max(len(text), len(item))
    of_text, of_item, tiles = _Running(text, most), _Running(item, most), []
    size = max(least, min(len(text), len(item)))
    while True:
        starts: dict[int, list[int]] = {}
        for h, i in of_item.windows(size, in_item):
            starts.setdefault(h, []).append(i)
        matches = []
        for h, t in of_text.windows(size, in_text):
            for i in starts.get(h, ()):
                if t and i and not in_text[t - 1] and not in_item[i - 1] and text[t - 1] == item[i - 1]:
                    continue  # part of the match that starts before
                n = 0
                while t + n < len(text) and i + n < len(item) and not in_text[t + n] and not in_item[i + n] and text[t + n] == item[i + n]:
                    n += 1
                if n >= size:
                    matches.append((-n, t, i))
        if matches and -min(matches)[0] > 2 * size:
            size = -min(matches)[0]
            continue
        matches.sort()
        rest = False
        for n, t, i in matches:
            if not in_text[t : t - n].any() and not in_item[i : i - n].any():
                in_text[t : t - n] = in_item[i : i - n] = True
                tiles.append((t, i, -n))
            else:
                rest = True  # what is left of it may be long enough still
        if rest:
            continue
        if size == least:
            return tiles
        size = max(least, size // 2)


@dataclass
class Items:
    """A block of items: their words, and their seeds in ascending order with the item of each."""

    ids: list[int]
    words: list[np.ndarray]
    least: int

    def __post_init__(self) -> None:
        every = [window_hashes(w, self.least) for w in self.words]
        seeds = np.concatenate([*every, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self.seeds >> np.uint64(64 - _SIEVE_BITS)] = True

    def found(self, x: np.ndarray) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item_id, coverage, tiles) of the items that share a seed with the words x."""
        h = window_hashes(x, self.least)
        at = np.flatnonzero(self.sieve[h >> np.uint64(64 - _SIEVE_BITS)])
        low, high = np.searchsorted(self.seeds, h[at]), np.searchsorted(self.seeds, h[at], "right")
        at, low, high = at[low < high], low[low < high], high[low < high]
        if not len(at):
            return []
        places: dict[int, list[int]] = {}
        for t, i, j in zip(at.tolist(), low.tolist(), high.tolist()):
            for number in set(self.owner[i:j].tolist()):
                places.setdefault(number, []).append(t)
        out = []
        for number, starts in sorted(places.items()):
            # only words of shared seeds can be in a tile; a gap keeps runs apart that aren't neighbours
            kept = np.unique(np.concatenate([np.arange(t, t + self.least) for t in starts]))
            breaks = np.flatnonzero(np.diff(kept) > 1) + 1
            part, origin = np.insert(x[kept], breaks, np.uint64(0)), np.insert(kept, breaks, -1)
            tiles = tile(part, self.words[number], self.least)
            share = sum(n for _, _, n in tiles) / len(self.words[number])
            out.append((self.ids[number], share, [(int(origin[t]), i, n) for t, i, n in tiles]))
        return out


def _blocks(items: DataFrame, item_col: str, text_col: str, least: int, block_chars: int) -> Iterator[Items]:
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    for block in range(n):
        held = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).orderBy("item_id", "text").collect()  # block_chars on average
        words = _WordHashes()
        every = [(r["item_id"], tokens(r["text"], words)) for r in held]
        every = [(i, w) for i, w in every if len(w) >= least]
        if every or block == 0:
            yield Items([i for i, _ in every], [w for _, w in every], least)


def _finder(spark, items: Items):
    shared = spark.sparkContext.broadcast(items)

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, block = _WordHashes(), shared.value
        for texts in batches:
            rows = []
            for text in texts:
                found = block.found(tokens(text, words)) if len(block.seeds) else []
                rows.append([{"item_id": i, "coverage": c, "tiles": [{"at": t, "item_at": j, "words": n} for t, j, n in tiles]} for i, c, tiles in found])
            yield pd.Series(rows)

    return find


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = TILE_WORDS, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns of docs with found (the items that share a seed: coverage and tiles, in words), coverage and contaminated after them.

    A text is contaminated if tiles cover the given share of an item.  A null text or one of
    fewer words than a tile shares nothing; nor does such an item, nor one with a null id or text.
    Items that repeat an id count each for itself.  Columns of docs with the added names are
    replaced; repeated rows are rows like any other; an empty table gives no rows."""
    spark, docs = docs.sparkSession, docs.drop("found", "coverage", "contaminated")
    blocks = _blocks(items, item_col, item_text_col, least, block_chars)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        out = docs.withColumn("found", _finder(spark, first)(F.col(text_col)))
    else:
        def hits(block: Items) -> DataFrame:
            found = docs.select(F.col(text_col).alias("text")).where("text is not null").withColumn("found", _finder(spark, block)(F.col("text")))
            return stored(found.where(F.size("found") > 0).select(F.sha2("text", 256).alias("_text"), "found").distinct(), "tiles")

        every = hits(first).unionByName(hits(second))
        for block in blocks:
            every = every.unionByName(hits(block))
        of_text = every.groupBy("_text").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))  # a row for each block
        out = docs.withColumn("_text", F.sha2(text_col, 256)).join(of_text, "_text", "left").drop("_text").withColumn("found", F.coalesce("found", F.array().cast(FOUND)))
    most = F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0))
    return out.withColumn("coverage", most).withColumn("contaminated", F.col("coverage") >= coverage)
