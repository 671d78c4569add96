"""The best chunks of each question through an index that skips what can't be among them.

The terms of a chunk are in one row, so its score needs no exchange: tasks build postings for
blocks of their chunks, each term with the greatest weight that a chunk of the block gives it.
The sum of a question's weights bounds its scores in the block; a block below the question's k-th
best score so far is skipped.  Each task gives k rows a question at most, whatever it has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergence.functions.text import terms
from vergence.operators.retrieval import BROADCAST_ROWS, lexical_scores, question_terms, top_k

#: Chunks of a block.
BLOCK_ROWS = 2048


class _Best:
    """A question's best rows so far: by score, then by the key's columns."""

    __slots__ = ("k", "score", "overlap", "key", "least")

    def __init__(self, k: int, width: int):
        self.k, self.least = k, -1.0
        self.score, self.overlap, self.key = np.empty(0), np.empty(0, np.int64), np.empty((width, 0), np.int64)

    def add(self, score: np.ndarray, overlap: np.ndarray, key: np.ndarray) -> None:
        score, overlap, key = np.r_[self.score, score], np.r_[self.overlap, overlap], np.concatenate([self.key, key], axis=1)
        best = np.lexsort((*key[::-1], -score))[: self.k]
        self.score, self.overlap, self.key = score[best], overlap[best], key[:, best]
        self.least = self.score[-1] if len(best) == self.k else -1.0


class Index:
    """The questions' terms by number, and each question's numbers side by side."""

    def __init__(self, rows: list[tuple[int, str]]):
        of: dict[int, list[str]] = {}
        for query_id, term in rows:
            of.setdefault(query_id, []).append(term)
        self.words = sorted({t for _, t in rows})
        number = {t: i for i, t in enumerate(self.words)}
        self.ids = list(of)
        self.numbers = [np.array(sorted(map(number.__getitem__, ts)), np.int64) for ts in of.values()]
        self.flat = np.concatenate([*self.numbers, np.empty(0, np.int64)])
        self.starts = np.cumsum([0, *map(len, self.numbers)])[:-1]

    def block(self, of_row: np.ndarray, numbers: np.ndarray, sizes: np.ndarray, keys: np.ndarray, best: list[_Best]) -> int:
        """Adds a block's chunks to the best rows; the number of questions that were scored.

        of_row, numbers: the chunk and the term of each posting.  sizes: terms of each chunk."""
        order = np.argsort(numbers, kind="stable")
        rows, numbers = of_row[order], numbers[order]
        ends = np.searchsorted(numbers, np.arange(len(self.words) + 1))
        weight = np.zeros(len(self.words))
        np.maximum.at(weight, numbers, 1 / np.sqrt(sizes[rows]))
        bounds, scored = np.add.reduceat(weight[self.flat], self.starts), 0
        # a rounded sum may be a little below the quotient that it bounds
        for i in np.flatnonzero((bounds > 0) & (bounds * (1 + 1e-9) >= np.fromiter((b.least for b in best), float, len(best)))).tolist():
            scored += 1
            met = np.bincount(np.concatenate([rows[ends[t] : ends[t + 1]] for t in self.numbers[i].tolist()]), minlength=0)
            at = np.flatnonzero(met)
            score = met[at] / np.sqrt(sizes[at])
            through = score >= best[i].least
            if through.any():
                at = at[through]
                best[i].add(score[through], met[at], keys[:, at])
        return scored


def lexical_top_k(questions: DataFrame, chunks: DataFrame, key: list[str], k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, *key, overlap, score, rank): as top_k(lexical_scores(...), k, *key), with k rows of a task and question exchanged at most.

    key: whole-number columns without nulls.  The questions' terms are broadcast only if their
    counted rows are few; beyond that the join of lexical_scores() gives the same rows."""
    asked = question_terms(questions).where("query_id is not null")
    if asked.count() > BROADCAST_ROWS:
        return top_k(lexical_scores(questions, chunks, key), k, *key)
    rows = [tuple(r) for r in asked.distinct().collect()]  # at most BROADCAST_ROWS
    if not rows:
        return top_k(lexical_scores(questions, chunks, key), k, *key)
    shared = questions.sparkSession.sparkContext.broadcast(Index(rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        words, best = pa.array(index.words, pa.string()), [_Best(k, len(key)) for _ in index.ids]
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                found = part.column("terms")
                sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False)
                numbers = pc.index_in(found.flatten(), value_set=words)
                met = np.flatnonzero(numbers.is_valid().to_numpy(zero_copy_only=False))
                of_row = np.repeat(np.arange(part.num_rows), sizes)
                index.block(of_row[met], numbers.take(pa.array(met)).to_numpy().astype(np.int64), sizes, np.stack([part.column(c).to_numpy() for c in key]), best)
        counts = [len(b.score) for b in best]
        arrays = [np.repeat(np.array(index.ids, np.int64), counts), *np.concatenate([b.key for b in best], axis=1), np.concatenate([b.overlap for b in best]), np.concatenate([b.score for b in best])]
        yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], ["query_id", *key, "overlap", "score"])

    every = chunks.select(*(F.col(c).cast("long").alias(c) for c in key), F.coalesce(terms(F.col("chunk")), F.array().cast("array<string>")).alias("terms"))
    schema = ", ".join(f"{c} long" for c in ("query_id", *key, "overlap"))
    return top_k(every.mapInArrow(score, f"{schema}, score double"), k, *key)
