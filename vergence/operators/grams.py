"""Document frequencies of character n-grams, level by level."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergence.operators.retrieval import BROADCAST_ROWS

#: The letters whose runs are cut, and the sizes of the pieces.
LETTERS, SIZES = "[一-龥]", (2, 3, 4)
#: Characters of texts whose pieces a worker holds at once, and what stands between texts.
LETTERS_HELD, _GAP = 1 << 20, np.array([0x110000], np.uint32)


def _stored(rows: DataFrame) -> DataFrame:
    """Cut from its lineage in the folder that the session names; a local one is set only where it names none."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return rows.checkpoint()


def _pieces(n: int, letters: str, frequent):
    """For each batch of texts, the pieces of n letters of their runs and how many texts of the batch have each, numbered in a batch so that codes fit in 64 bits.

    frequent: a broadcast list of the pieces of n - 1 letters of which both parts of a piece must be, or None."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_letters = re.compile(letters)
        is_letter = np.zeros(0x110001, bool)  # the last place stands between texts
        is_letter[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and of_letters.fullmatch(chr(c))]] = True
        held = None if frequent is None else _points(frequent.value, n - 1)
        for batch in batches:
            for texts in _bounded(batch.column(0).to_pylist()):
                codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
                flat = np.concatenate([x for c in codes for x in (c, _GAP)])
                owner = np.repeat(np.arange(len(texts)), [len(c) + 1 for c in codes])
                good = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(is_letter[flat], n).all(axis=1)) if len(flat) >= n else np.empty(0, np.int64)
                if not len(good):
                    continue
                alphabet = np.unique(flat[is_letter[flat]])
                place = np.searchsorted(alphabet, flat)  # of letters only
                if held is not None:
                    inside = held[np.isin(held, alphabet).all(axis=1)] if len(held) else held
                    known = np.sort(_codes(np.searchsorted(alphabet, inside).T, len(alphabet)))
                    for shift in (0, 1):
                        good = good[np.isin(_codes([place[good + shift + i] for i in range(n - 1)], len(alphabet)), known)]
                windows = _codes([place[good + i] for i in range(n)], len(alphabet))
                distinct, number = np.unique(windows, return_inverse=True)
                pairs = np.unique(owner[good] * max(1, len(distinct)) + number)
                df = np.bincount(pairs % max(1, len(distinct)), minlength=len(distinct))
                points = np.stack([alphabet[distinct // len(alphabet) ** (n - 1 - i) % len(alphabet)] for i in range(n)], axis=1)
                text = points.astype("<u4").tobytes().decode("utf-32-le")
                yield pa.RecordBatch.from_pydict({"gram": pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string()), "df": pa.array(df, pa.int64())})

    return count


def _codes(columns, base: int) -> np.ndarray:
    """One number of places below base side by side."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = out * base + c
    return out


def _points(grams: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, n)


def _bounded(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts by some LETTERS_HELD characters, one at least."""
    out, size = [], 0
    for t in texts:
        if t:
            out.append(t)
            size += len(t)
            if size >= LETTERS_HELD:
                yield out
                out, size = [], 0
    if out:
        yield out


def gram_frequencies(rows: DataFrame, text_col: str, least: int, letters: str = LETTERS, sizes: tuple[int, ...] = SIZES, most: int = BROADCAST_ROWS) -> DataFrame:
    """(n, gram, df): the pieces of n letters of a run that at least `least` texts have, for consecutive sizes.

    letters: a class of characters that Python writes as Java does; at most 55,000 of them (the fourth root of 2^63) meet in LETTERS_HELD characters of text.
    A text counts a piece once.  A piece can only be frequent if the one without its last and the one without its first letter are,
    so that from the second size on others are dropped in the task that cuts them, before anything is shuffled; then what is exchanged
    is sums over some texts of pieces whose parts are frequent.  The frequent pieces are broadcast for that if they are at most
    `most` by count; beyond it all pieces are counted, which gives the same rows.  Null and empty texts have no piece."""
    spark = rows.sparkSession
    out = frequent = None
    for n in sizes:
        few = None
        if frequent is not None and frequent.count() <= most:
            few = spark.sparkContext.broadcast([r[0] for r in frequent.select("gram").collect()])
        each = rows.select(F.col(text_col).alias("text")).mapInArrow(_pieces(n, letters, few), "gram string, df long")
        counts = each.groupBy("gram").agg(F.sum("df").alias("df")).where(F.col("df") >= least)
        level = _stored(counts.select(F.lit(n).alias("n"), "gram", "df"))
        out, frequent = level if out is None else out.unionByName(level), level
    return out
