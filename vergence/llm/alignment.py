"""Alignment of two tokenizers' tokens over the bytes of a text.

Each byte gets a label: n if no token ends with it, a or b if one of A or of B does, x if both do.
A regular expression cuts the label string after each x; a span's labels count the tokens of both
sides in its group.  Both tokenizers start anew at a space before a word and at a line feed between
words, so a text is cut there, each distinct segment is encoded and aligned once for many texts,
and the segments' groups stand side by side.  How many documents hold a pair of ids linked is
counted over the corpus by Spark; the counts come back to the documents by a join, in which the
pairs of many documents, at most HEAD_PAIRS of them, are broadcast.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergence.llm.common import Scratch

#: Most pairs of ids that are broadcast with their counts: those in more documents than the corpus' linked pairs over this.
HEAD_PAIRS = 1_000_000
#: Most segments that a worker process knows at once; longer ones than so many characters are aligned each time.
_KEPT_SEGMENTS, _KEPT_CHARS = 300_000, 4_096
#: Characters of text that are cut and encoded together, and counted pairs that a task holds before it adds them up.
_SLICE_CHARS, _HELD_PAIRS = 2_000_000, 4_000_000
_ODD, _PLAIN, _CUTS = re.compile(r"\s\s|\s\Z"), re.compile(r"[ \n][^ \n]+"), re.compile(r"(?<! )(?= \S)|(?<=\S)(?=\n\S)")
_LABELS, _GROUP = np.frombuffer(b"nabx", np.uint8), re.compile(rb"[nab]*x")
_SPACE = "▁"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others in order from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


@dataclass(frozen=True)
class Alignment:
    """The tokens of a text: ids and the byte offsets of their ends, and how many of each side a group has."""

    a_ids: np.ndarray
    a_ends: np.ndarray
    b_ids: np.ndarray
    b_ends: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of A and of B over each stretch between ends: every overlapping pair once."""
        ends = np.union1d(self.a_ends, self.b_ends)
        return np.searchsorted(self.a_ends, ends), np.searchsorted(self.b_ends, ends)


def align(a_ids: np.ndarray, a_lengths: np.ndarray, b_ids: np.ndarray, b_lengths: np.ndarray) -> Alignment:
    """Aligns two tokenizations of the same bytes."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    labels = np.zeros(a_ends[-1] if len(a_ends) else 0, np.uint8)
    labels[a_ends - 1] = 1
    labels[b_ends - 1] += 2
    spans = _GROUP.findall(_LABELS[labels].tobytes())
    both = np.fromiter((s.count(b"a") << 32 | s.count(b"b") for s in spans), np.int64, len(spans)) + (1 << 32 | 1)
    return Alignment(a_ids, a_ends, b_ids, b_ends, both >> 32, both & 0xFFFFFFFF)


def written(x: Alignment, last: np.ndarray | None = None) -> list[str]:
    """The groups as `a1,a2|b1;a3|b2,b3`, in a string for each run of groups that ends with one marked in last."""
    if not len(x.a_sizes):
        return []
    last = np.arange(len(x.a_sizes)) == len(x.a_sizes) - 1 if last is None else last
    a_last, b_last = np.cumsum(x.a_sizes), np.cumsum(x.b_sizes)
    # 0 and 2 go on with a comma, 1 ends A's side, 3 ends a group, 4 a run; B's tokens stand after all of A's in their group
    a_marks, b_marks = np.zeros(len(x.a_ids), np.int64), np.full(len(x.b_ids), 2)
    a_marks[a_last - 1], b_marks[b_last - 1] = 1, np.where(last, 4, 3)
    at = np.r_[np.arange(len(x.a_ids)) + np.repeat(b_last - x.b_sizes, x.a_sizes), np.arange(len(x.b_ids)) + np.repeat(a_last, x.b_sizes)]
    ids, marks = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    ids[at], marks[at] = np.r_[x.a_ids, x.b_ids], np.r_[a_marks, b_marks]
    return "".join(chain.from_iterable(zip(map(str, ids.tolist()), map((",", "|", ",", ";", "\n").__getitem__, marks.tolist())))).split("\n")[:-1]


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json.decode()), SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        of, vocabulary = _byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        starts = getattr(self.a.pre_tokenizer, "add_prefix_space", None) is False and getattr(self.a.pre_tokenizer, "use_regex", False) and self.a.normalizer is None
        #: Segments are encoded as they are within a text.
        self.cuts = starts and not any(_SPACE in p.lstrip(_SPACE) or "\n" in p and len(p) > 1 for p in pieces)

    def segments(self, text: str) -> list[str]:
        """A space and the text, cut where both tokenizers start anew."""
        text = " " + text
        if not self.cuts:
            return [text]
        return _PLAIN.findall(text) if not _ODD.search(text) else [s for s in _CUTS.split(text) if s]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """The ids of A and of B for each segment, and where the tokens' joined bytes are the segment's.  One that starts with a line feed loses the space that B sets first."""
        of_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        of_b = [b if s[0] == " " else b[1:] for s, b in zip(segments, self.b.encode([s.removeprefix(" ") for s in segments], num_threads=1))]
        data, same = [s.encode() for s in segments], []
        for ids, table in ((of_a, self.a_bytes), (of_b, self.b_bytes)):
            same.append(np.fromiter((b"".join(map(table.__getitem__, x)) == d for x, d in zip(ids, data)), bool, len(data)))
        return of_a, of_b, same[0] & same[1]

    def aligned(self, of_a: list[list[int]], of_b: list[list[int]]) -> tuple[Alignment, np.ndarray, np.ndarray]:
        """The alignment of all segments in a row, and how many tokens of A and of B each has."""
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((of_a, n_a), (of_b, n_b)))
        return align(a, self.a_lengths[a], b, self.b_lengths[b]), n_a, n_b


class _Segments:
    """Aligned segments by number: counts, written groups, and the linked pairs of all side by side."""

    def __init__(self, tools: Tokenizers):
        self.tools = tools
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts, self.pairs = np.empty((0, 4), np.int64), np.empty(0, np.int64)  # tokens of A and of B, groups, links

    def add(self, segments: list[str]) -> None:
        """Aligns segments that aren't known; those that a tokenizer doesn't give back have counts of zero."""
        of_a, of_b, good = self.tools.encode(segments)
        order = np.r_[np.flatnonzero(good), np.flatnonzero(~good)]
        for i in order.tolist():
            self.number[segments[i]] = len(self.number)
        good = np.flatnonzero(good).tolist()
        x, n_a, n_b = self.tools.aligned([of_a[i] for i in good], [of_b[i] for i in good])
        ends = x.a_ends[np.cumsum(n_a) - 1]
        group_ends = x.a_ends[np.cumsum(x.a_sizes) - 1]
        i, j = x.links()
        counts = np.zeros((len(segments), 4), np.int64)
        of_segment = lambda at: np.bincount(np.searchsorted(ends, at), minlength=len(ends))
        counts[: len(good)] = np.stack([n_a, n_b, of_segment(group_ends), of_segment(np.union1d(x.a_ends, x.b_ends))], 1)
        self.texts += written(x, np.isin(group_ends, ends)) + [""] * (len(segments) - len(good))
        self.counts, self.pairs = np.concatenate([self.counts, counts]), np.concatenate([self.pairs, x.a_ids[i] << 32 | x.b_ids[j]])


_HELD: dict[tuple[bytes, bytes], _Segments] = {}


def _segments_of(a_json: bytes, b_model: bytes) -> _Segments:
    """One for each worker process, so that what is aligned serves all its tasks."""
    key = (sha256(a_json).digest(), sha256(b_model).digest())
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = _Segments(Tokenizers(a_json, b_model))
    return _HELD[key]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def aligned_groups(docs: DataFrame, a_json: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group, start, end, a_ids, b_ids): the groups of each text in order, with byte offsets in a space and the text.

    A text that is null or empty, or that a tokenizer doesn't give back byte by byte, has no rows;
    repeated rows and null ids are aligned like any other; an empty table gives no rows."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _segments_of(a_json, b_model).tools
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                of_a, of_b, good = tools.encode(tools.segments(text.as_py()) if text.as_py() else [])
                if len(good) and good.all():
                    x, _, _ = tools.aligned(of_a, of_b)
                    a, b = np.r_[0, np.cumsum(x.a_sizes)].astype(np.int32), np.r_[0, np.cumsum(x.b_sizes)].astype(np.int32)
                    ends = x.a_ends[a[1:] - 1]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([doc] * len(ends), pa.int64()), "group": pa.array(np.arange(len(ends), dtype=np.int32)), "start": pa.array(np.r_[0, ends[:-1]], pa.int64()), "end": pa.array(ends, pa.int64()),
                        "a_ids": pa.ListArray.from_arrays(a, pa.array(x.a_ids, pa.int32())), "b_ids": pa.ListArray.from_arrays(b, pa.array(x.b_ids, pa.int32())),
                    })

    return _texts(docs, id_col, text_col).mapInArrow(groups, "doc_id long, group int, start long, end long, a_ids array<int>, b_ids array<int>")


_COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _aligned(texts: DataFrame, a_json: bytes, b_model: bytes) -> DataFrame:
    """Counts of each text, the digest of its groups, and its different linked pairs (A's id above B's 32 bits) with how often each stands."""
    shared = texts.sparkSession.sparkContext.broadcast((a_json, b_model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _segments_of(*shared.value)

        def rows(ids: list, cut: list[list[str]]) -> pa.RecordBatch:
            if len(known.texts) > _KEPT_SEGMENTS:
                known.clear()
            number = known.number
            if fresh := [s for s in set(chain.from_iterable(cut)) if s not in number]:
                known.add(fresh)
            counts, texts = known.counts, known.texts
            sizes = counts[:, 3]
            starts, out = np.cumsum(sizes) - sizes, []
            for segments in cut:
                at = np.fromiter(map(number.__getitem__, segments), np.int64, len(segments))
                of, times = np.unique(at, return_counts=True)
                if not len(of) or (counts[of, 0] == 0).any():  # no text, or one that a tokenizer changes
                    out.append((0, 0, 0, 0, "", [], []))
                    continue
                n = sizes[of]
                linked, back = np.unique(known.pairs[np.arange(n.sum()) + np.repeat(starts[of] - np.cumsum(n) + n, n)], return_inverse=True)
                groups = ";".join(map(texts.__getitem__, at.tolist()))
                out.append((*(times @ counts[of]).tolist(), sha256(groups.encode()).hexdigest(), linked, np.bincount(back, np.repeat(times, n)).astype(np.int32)))
            if max(map(len, fresh), default=0) > _KEPT_CHARS:  # long segments hardly come again
                known.clear()
            columns = list(zip(*out))
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in values])], pa.int32()), pa.array(np.concatenate([np.asarray(v, kind.to_pandas_dtype()) for v in values]), kind))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]), lists(columns[5], pa.int64()), lists(columns[6], pa.int32())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        ids, cut, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                ids.append(doc)
                cut.append(known.tools.segments(text) if text else [])
                size += len(text)
                if size > _SLICE_CHARS:
                    yield rows(ids, cut)
                    ids, cut, size = [], [], 0
        if ids:
            yield rows(ids, cut)

    return texts.mapInArrow(count, _COUNTED)


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold the pair linked; added up within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_pydict({"pair": keys[at : at + 100_000], "n": n[at : at + 100_000].astype(np.int64)})

        for batch in batches:
            held.append(batch.column("pairs").flatten().to_numpy())
            size += len(held[-1])
            if size > _HELD_PAIRS:
                yield from added()
                held, size = [], 0
        if size:
            yield from added()

    return aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_counts(docs: DataFrame, a_json: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each row of docs.

    A text that is null or empty, or that a tokenizer doesn't give back byte by byte, has no tokens:
    zeros, and an empty digest.  Repeated rows and null ids are documents like any other, and count
    as such; other columns are ignored; an empty table gives no rows.  A task holds a text and its
    tokens whole, whatever its length.  head_pairs bounds what is broadcast, not what is counted."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    aligned = scratch.table(_aligned(_texts(docs, id_col, text_col), a_json, b_model).withColumn("row", F.monotonically_increasing_id()))
    counts = scratch.table(_pair_counts(aligned))
    least = (counts.agg(F.sum("n")).first()[0] or 0) // head_pairs  # fewer than head_pairs pairs have more
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("best"))  # as many rows as A has ids
    table = counts.where(F.col("n") > least).orderBy("pair").toArrow()
    of_a = best.toArrow()
    most = np.zeros((max(of_a["a"].to_pylist(), default=0)) + 1, np.int64)
    most[of_a["a"].to_numpy()] = of_a["best"].to_numpy()
    shared = spark.sparkContext.broadcast((table["pair"].to_numpy(), table["n"].to_numpy(), most))

    def known(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it was broadcast, its count) of each pair."""
        keys, n, _ = shared.value
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        return found, np.where(found, n[at], 0) if len(keys) else np.zeros(len(pairs), np.int64)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            of_row, keys = pairs.value_parent_indices().to_numpy() if hasattr(pairs, "value_parent_indices") else np.repeat(np.arange(len(pairs)), pairs.value_lengths().to_numpy()), pairs.flatten().to_numpy()
            _, n = known(keys)
            add = lambda x: pa.array(np.bincount(of_row, x, minlength=batch.num_rows).astype(np.int64)) if x.sum() < 1 << 52 else pa.array([int(x[of_row == i].sum()) for i in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), add(times * (n == shared.value[2][keys >> 32]) * (n > 0)), add(times * n)], [*names, "n_best", "count_sum"])

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch.column("pairs")
            keys, rows = pairs.flatten().to_numpy(), np.repeat(batch.column("row").to_numpy(), pairs.value_lengths().to_numpy())
            cold = ~known(keys)[0]
            yield pa.RecordBatch.from_pydict({"row": rows[cold], "pair": keys[cold], "times": batch.column("times").flatten().to_numpy()[cold]})

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    of_head = aligned.select(*names, "pairs", "times").mapInArrow(head, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    rare = counts.where(F.col("n") <= least).withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    of_tail = aligned.select("row", "pairs", "times").mapInArrow(tail, "row long, pair long, times int").join(rare, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("is_best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    plus = lambda name, more: (F.col(name) + F.coalesce(F.col(more), F.lit(0))).alias(name)
    return scratch.last(of_head.join(of_tail, "row", "left").select(*names[1:6], plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256"))
