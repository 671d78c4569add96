"""Source divergence: how far the sources of a language differ in their terms, and by which terms.

A first pass over the texts fills a count-min sketch of document frequencies in each task; merged,
it never underestimates, so terms below the threshold in it are impossible and never reach the
second pass's shuffle, which counts the others exactly.  Divergences are integer sums: terms that
neither of two sources has are one product, terms of one source are summed by equal counts, and
only terms that both have meet in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vergence.llm.common import Scratch, sized_broadcast

#: A term, and the unit of shares.
TERM, UNIT = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", 1_000_000_000
#: Documents of a language that a kept term is in, and the last rank of a term.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Rows of the sketch; bytes of text for each of a row's cells; the least and the most cells of a row, as powers of two.
DEPTH, BYTES_PER_CELL, CELL_POWERS = 3, 128, (16, 26)
#: Cells of a block, the unit in which sketches are merged.
_BLOCK_POWER = 16
#: Bytes of text that become terms together, and cells that a task holds before it gives them to Spark.
_SLICE_BYTES, _HELD_CELLS = 4_000_000, 2_000_000
#: Each byte of a term is itself, A-Z in lower case, and any other a space: UTF-8 has no such byte inside a character.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[str]:
    return [t.decode() for t in text.encode().translate(_BYTES).split()]


def cells(lang: str, words: list[bytes], power: int, depth: int = DEPTH) -> np.ndarray:
    """The cell of each word in each row of the sketch, shape (depth, words)."""
    seed = xxhash.xxh64_intdigest(lang)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - power) for i in range(depth)]).astype(np.int64)


class _Slice:
    """The terms of some texts as numbers: of each token its number and its document."""

    def __init__(self, langs: list[str], sources: list[str], texts: list[bytes]):
        self.langs, self.sources = langs, sources
        data = np.frombuffer(b" " + b" ".join(t.translate(_BYTES) for t in texts) + b" ", np.uint8)
        inside = data != 32
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        of_text = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum([len(t) + 1 for t in texts])]))
        offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        encoded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        self.doc = np.repeat(np.arange(len(texts)), of_text)
        self.words, self.code = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, number) of each of a document's different terms."""
        key = np.sort(self.doc * max(1, len(self.words)) + self.code)
        return np.divmod(key[np.r_[True, key[1:] != key[:-1]][: len(key)]], max(1, len(self.words)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for batch in batches:
        ends = np.cumsum(batch.column("n_bytes").to_numpy()) // _SLICE_BYTES
        for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(ends)) + 1):
            if len(at):
                yield _Slice(*(batch.column(c).slice(at[0], len(at)).to_pylist() for c in ("lang", "source", "text")))


def possible_cells(docs: DataFrame, power: int, least: int = LEAST_DOCS, depth: int = DEPTH) -> np.ndarray:
    """Which cells of the merged sketch reach the threshold, shape (depth, cells).

    Each task gives its cells as sparse blocks; a block's tasks are added in one place as they
    arrive, and one bit a cell goes to the driver: depth x 2^power bits, 25 MB at the very most.
    Counts saturate at 255, which the threshold stays below."""
    block = min(power, _BLOCK_POWER)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, back = np.unique(at, return_inverse=True)
            return at, np.minimum(np.bincount(back, n), 255).astype(np.uint8)

        def given() -> Iterator[pa.RecordBatch]:
            at, n = summed(*map(np.concatenate, zip(*held)))
            ends = np.flatnonzero(np.diff(at >> block, append=-1)) + 1
            for i, j in zip([0, *ends[:-1]], ends):
                yield pa.RecordBatch.from_pydict({"block": pa.array([int(at[i] >> block)], pa.int64()), "cells": [(at[i:j] & ((1 << block) - 1)).astype("<u2").tobytes()], "n": [n[i:j].tobytes()]})

        for s in _slices(batches):
            doc, code = s.once()
            names = sorted(set(s.langs))
            number = {lang: i for i, lang in enumerate(names)}
            of_lang = np.fromiter(map(number.__getitem__, s.langs), np.int64, len(s.langs))[doc]
            for lang, i in number.items():
                code_of, n = np.unique(code[of_lang == i], return_counts=True)
                at = cells(lang, s.words.take(pa.array(code_of)).to_pylist(), power, depth) + (np.arange(depth) << power)[:, None]
                held.append(summed(at.ravel(), np.tile(n, depth)))
                size += len(held[-1][0])
            if size > _HELD_CELLS:
                yield from given()
                held, size = [], 0
        if held:
            yield from given()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, at, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                of = sums.setdefault(key, np.zeros(1 << block, np.uint8))
                at = np.frombuffer(at, "<u2")
                of[at] = np.minimum(of[at].astype(np.uint16) + np.frombuffer(n, np.uint8), 255)
        for key, of in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([key], pa.int64()), "bits": [np.packbits(of >= least).tobytes()]})

    blocks = depth << (power - block)
    merged = docs.mapInArrow(fill, "block long, cells binary, n binary").repartition(min(blocks, 4096), "block").mapInArrow(merge, "block long, bits binary")
    out = np.zeros((blocks, 1 << block), bool)
    for key, bits in merged.collect():  # the bits of the sketch
        out[key] = np.unpackbits(np.frombuffer(bits, np.uint8), count=1 << block)
    return out.reshape(depth, 1 << power)


def _survivors(docs: DataFrame, possible: np.ndarray, power: int) -> DataFrame:
    """(lang, source, term, n, docs): counts, summed within slices of a task, of the terms that the sketch lets through."""
    shared, depth = docs.sparkSession.sparkContext.broadcast(np.packbits(possible)), len(possible)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).reshape(depth, -1)
        for s in _slices(batches):
            groups = sorted(set(zip(s.langs, s.sources)))
            number, most = {g: i for i, g in enumerate(groups)}, max(1, len(s.words))
            of_doc = np.fromiter(map(number.__getitem__, zip(s.langs, s.sources)), np.int64, len(s.langs))
            doc, code = s.once()
            key, n = np.unique(of_doc[s.doc] * most + s.code, return_counts=True)
            same, n_docs = np.unique(of_doc[doc] * most + code, return_counts=True)
            assert np.array_equal(key, same)
            lang_names = sorted(set(s.langs))
            lang_of = np.array([lang_names.index(lang) for lang, _ in groups], np.int64)[key // most] if groups else key
            through = np.zeros(len(key), bool)
            for i, lang in enumerate(lang_names):
                rows = np.flatnonzero(lang_of == i)
                code_of, back = np.unique(key[rows] % most, return_inverse=True)
                at = cells(lang, s.words.take(pa.array(code_of)).to_pylist(), power, depth)
                through[rows] = np.logical_and.reduce([table[r][at[r]] for r in range(depth)]).astype(bool)[back]
            key, n, n_docs = key[through], n[through], n_docs[through]
            named = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(key // most)) for i in (0, 1)]
            out = pa.RecordBatch.from_arrays([*named, s.words.take(pa.array(key % most)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())], ["lang", "source", "term", "n", "docs"])
            for at in range(0, out.num_rows, 50_000):
                yield out.slice(at, 50_000)

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)), exact for any count."""
    d = "decimal(20,0)"
    short = F.call_function("div", F.lit(UNIT).cast("long") * (n + 1), total + kept)
    long = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast(d), (total + kept).cast(d))
    return F.when(total + kept == 0, F.lit(0).cast("long")).when(n < 9_000_000_000, short + 1).otherwise(long + 1)


def _far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 1,000,000,001, so that squares fit."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP_TERMS, cell_power: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair has the other sources of the lang, part term the terms that a source has more of.

    Null texts, langs and sources count as empty ones; each row is a document, so a repeated row
    counts again.  A group whose texts have no terms is compared like any other; a language in
    which no term is kept has pairs of value 0.  Equal values stand by the items' UTF-8.  Other
    columns are ignored; an empty table gives no rows.  A text is held whole by its task, whatever
    its length.  cell_power: the sketch's width, by the bytes of text if not given; it decides only
    how many terms are counted in vain."""
    scratch = Scratch(docs.sparkSession)
    if not 1 <= least <= 255:
        raise ValueError("the sketch's counts end at 255")
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    texts = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).cast("binary").alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    if cell_power is None:
        size = texts.agg(F.sum("n_bytes")).first()[0] or 0
        cell_power = min(max(CELL_POWERS[0], (size // BYTES_PER_CELL).bit_length()), CELL_POWERS[1])
    possible = possible_cells(texts, cell_power, least)
    exact = _survivors(texts, possible, cell_power).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    of_lang = exact.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": (F.min("source").over(of_term) == F.col("source")).cast("long")})
    counts = scratch.table(of_lang.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", "first"))

    totals = scratch.table(counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts")))
    sizes = totals.groupBy("lang").agg(F.sum("firsts").alias("kept"), F.sum("total").alias("lang_total"))
    groups = texts.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals.drop("firsts"), ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "total"])
    groups = scratch.table(groups.withColumn("none", _share(F.lit(0), F.col("total"), F.col("kept"))).withColumn("g", F.monotonically_increasing_id()))
    n_groups = groups.count()
    group = sized_broadcast(groups, n_groups)

    share = _share(F.col("n"), F.col("total"), F.col("kept")).alias("p")
    shares = scratch.table(counts.join(group, ["lang", "source"]).select("g", "lang", "term", share, _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "none"))
    best = Window.partitionBy("g").orderBy(F.col("value").desc(), "item")
    of_terms = shares.where("p > q").select("g", F.col("term").alias("item"), _far(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    of_terms = of_terms.join(sized_broadcast(groups.select("g", "lang", "source"), n_groups), "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    ours = groups.select("lang", "source", "g", "none", "kept")
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("none").alias("item_none"))
    pairs = scratch.table(ours.join(theirs, "lang").where("g != h").withColumn("neither", F.when(F.col("kept") > 0, _far(F.col("none"), F.col("item_none"))).otherwise(0)))
    near = sized_broadcast(pairs.select("g", "h", "none", "item_none", "neither"), pairs.count())
    alike = scratch.table(shares.groupBy("g", "p").agg(F.count("*").alias("terms")))
    of_g = alike.join(near, "g").groupBy("g", "h").agg(F.sum(F.col("terms") * (_far(F.col("p"), F.col("item_none")) - F.col("neither"))).alias("more"))
    of_h = alike.withColumnRenamed("g", "h").join(near, "h").groupBy("g", "h").agg(F.sum(F.col("terms") * (_far(F.col("none"), F.col("p")) - F.col("neither"))).alias("more"))
    met = shares.select("lang", "term", "g", "p", "none").join(shares.select("lang", "term", F.col("g").alias("h"), F.col("p").alias("o"), F.col("none").alias("item_none")), ["lang", "term"]).where("g < h")

    def apart(p: str, none: str, o: str, other: str) -> Column:
        """What a term of both is more than the sum of what it counted as a term of each."""
        return _far(F.col(p), F.col(o)) - _far(F.col(p), F.col(other)) - _far(F.col(none), F.col(o)) + _far(F.col(none), F.col(other))

    both = met.groupBy("g", "h").agg(F.sum(apart("p", "none", "o", "item_none")).alias("there"), F.sum(apart("o", "item_none", "p", "none")).alias("back"))
    both = both.select(F.inline(F.array(F.struct("g", "h", F.col("there").alias("more")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("more")))))
    base = pairs.select("g", "h", (F.col("kept") * F.col("neither")).alias("more"))
    values = base.unionByName(of_g).unionByName(of_h).unionByName(both).groupBy("g", "h").agg(F.sum("more").alias("value"))
    of_pairs = values.join(pairs.select("g", "h", "lang", "source", "item"), ["g", "h"]).withColumn("rank", F.row_number().over(best)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return scratch.last(of_pairs.unionByName(of_terms))
