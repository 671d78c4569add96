"""Byte-level BPE by a shuffle of distinct words.

A pass over the texts splits them into pre-tokens and gives, for each block of documents, the
block's distinct words once, in lists by a hash of the word, and each document as the numbers of
its words by position.  The lists of all blocks meet by hash, each distinct word is encoded once,
the ids are joined back to the blocks that have it, and every document is put together again by
position.  What the pass gives is shuffled once, by block, and read from there both for the words
and for the documents.  Decoding takes the ids' bytes from the table of token bytes, which every
worker holds and whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text after which a block of documents ends, bytes of text for each bucket of words, and the most buckets.
BLOCK_BYTES, BUCKET_BYTES, MOST_BUCKETS = 5 << 20, 256 << 20, 4096
#: Distinct words that a worker keeps encoded at once; beyond it starts anew.
_KEPT_WORDS = 1_000_000
_BATCH, _ROW_CODES, _SLICE_ROWS = 512, 1 << 17, 256


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Joins the neighbours of least rank, the leftmost first, until none can be joined."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    ends, before, after = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
    queue = [(r, i, i + 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, end = heapq.heappop(queue)
        j = after[i] if ends[i] else -1
        if j < 0 or ends[j] != end:
            continue  # one of the two has been joined since
        ends[i], ends[j], after[i] = end, 0, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            if (r := ranks.get(word[i : ends[after[i]]])) is not None:
                heapq.heappush(queue, (r, i, ends[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : end])) is not None:
            heapq.heappush(queue, (r, before[i], end))
    ids, i = [], 0
    while i >= 0 and word:
        ids.append(ranks[word[i : ends[i]]])
        i = after[i]
    return ids


class _Numbers(dict):
    """Words in the order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as compressed byte planes; high planes of zeros cost next to nothing."""
    return zstandard.ZstdCompressor(level=3).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _joined(parts: list[bytes]) -> tuple[bytes, bytes]:
    """(lengths, contents), both compressed."""
    return packed(np.fromiter(map(len, parts), np.uint32, len(parts))), zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _parted(lengths: bytes, contents: bytes) -> list[bytes]:
    ends, data = np.cumsum(unpacked(lengths), dtype=np.int64).tolist(), zstandard.ZstdDecompressor().decompress(contents)
    return [data[i:j] for i, j in zip([0, *ends[:-1]], ends)]


_BLOCK = "block long, doc_ids array<string>, codes binary, bucket int, lengths binary, contents binary"

_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.string())), ("codes", pa.binary()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("contents", pa.binary())])


def _blocks(docs: DataFrame, pattern: str, block_bytes: int, buckets: int) -> DataFrame:
    """Rows of a block: (doc_ids, codes, lengths) of some documents, then its distinct words by bucket, then each word's bucket.

    Codes number a block's words by falling frequency; within a bucket the words stand by number."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, block = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        words, ids, codes, size = _Numbers(), [], [], 0

        def made(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block] * n if f.name == "block" else columns.get(f.name, [None] * n), f.type) for f in _BLOCK_ARROW], schema=_BLOCK_ARROW)

        def rows() -> Iterator[pa.RecordBatch]:
            order = np.argsort(-np.bincount(np.concatenate(codes), minlength=len(words)), kind="stable") if words else np.empty(0, np.int64)
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            ends = np.cumsum([len(c) for c in codes]) // _ROW_CODES  # documents of a row
            for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ends)) + 1):
                row = packed(number[np.concatenate([codes[i] for i in at])])
                yield made(1, doc_ids=[[ids[i] for i in at]], codes=[row], lengths=[packed(np.array([len(codes[i]) for i in at], np.uint32))])
            seen = [w.encode("utf-8", "surrogatepass") for w in words]
            of_bucket, every = [[] for _ in range(buckets)], np.empty(len(seen), np.uint32)
            for n, i in enumerate(order.tolist()):
                every[n] = at = xxhash.xxh32_intdigest(seen[i]) % buckets
                of_bucket[at].append(seen[i])
            lists = [(i, *_joined(of)) for i, of in enumerate(of_bucket) if of] + [(None, packed(every), None)]
            for i in range(0, len(lists), _BATCH):
                bucket, lengths, contents = zip(*lists[i : i + _BATCH])
                yield made(len(bucket), bucket=bucket, lengths=lengths, contents=contents)

        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):  # so that few texts are held at once
                part = batch.slice(at, _SLICE_ROWS)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    found = find(text)
                    codes.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                    ids.append(None if doc is None else str(doc))
                    size += len(text)
                    if size >= block_bytes:
                        yield from rows()
                        words, ids, codes, size, block = _Numbers(), [], [], 0, block + 1
        if ids:
            yield from rows()

    return docs.mapInArrow(split, _BLOCK)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids as little-endian unsigned 32-bit integers, one row for each row of docs.

    With `decoded` also bytes, what decode() gives for the ids, looked up where a document is put
    together: decode() behind encode() would keep a second Python worker for each task.

    Each match of the pattern is encoded separately, without special tokens.  A null or empty text
    has no ids.  Repeated rows and null ids are encoded like any other; other columns are ignored;
    an empty table gives no rows.  A text is held whole by its task, whatever its length."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(parts, -(-total // BUCKET_BYTES)))
    blocks = _blocks(texts, pattern, block_bytes, buckets).repartition(max(parts, -(-total // BUCKET_BYTES)), "block")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(batch.column("bucket").is_valid()).select(["block", "bucket", "lengths", "contents"])

    def ids_of_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, last, known = read_ranks(ranks), None, {}
        for pdf in batches:
            out = []
            for bucket, lengths, contents in zip(pdf["bucket"], pdf["lengths"], pdf["contents"]):
                words = _parted(lengths, contents)
                if bucket != last or len(known) + len(words) > _KEPT_WORDS:
                    last, known = bucket, {}
                for word in words:
                    if word not in known:
                        known[word] = np.array(merge(word, table), "<u4").tobytes()
                found = list(map(known.__getitem__, words))
                out.append((packed(np.fromiter(map(len, found), np.uint32, len(found)) // 4), packed(np.frombuffer(b"".join(found), "<u4"))))
            sizes, ids = zip(*out) if out else ((), ())
            yield pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "sizes": sizes, "ids": ids})

    # both sides read the same shuffle by block: all columns go to Python, so that neither side's plan prunes them below it
    together = blocks.mapInArrow(lists, "block long, bucket int, lengths binary, contents binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    encoded = together.mapInPandas(ids_of_words, "block long, bucket int, sizes binary, ids binary")

    look_up = _look_up(ranks) if decoded else None

    def assemble(of_docs: pd.DataFrame, of_words: pd.DataFrame) -> pd.DataFrame:
        of_docs = of_docs[of_docs["bucket"].isna()]
        head = of_docs["codes"].isna()
        order = np.argsort(unpacked(of_docs["lengths"][head].iloc[0]), kind="stable")  # numbers by bucket
        of_words = of_words.sort_values("bucket")
        sizes = np.concatenate([*map(unpacked, of_words["sizes"]), np.empty(0, np.uint32)]).astype(np.int64)
        ids, starts = np.concatenate([*map(unpacked, of_words["ids"]), np.empty(0, np.uint32)]), np.zeros(len(order), np.int64)
        size = np.zeros(len(order), np.int64)
        starts[order], size[order] = np.cumsum(sizes) - sizes, sizes
        of_docs, docs, out = of_docs[~head], [], []
        for doc_ids, codes, lengths in zip(of_docs["doc_ids"], map(unpacked, of_docs["codes"]), map(unpacked, of_docs["lengths"])):
            docs += [None if d is None else int(d) for d in doc_ids]
            for of in np.split(codes, np.cumsum(lengths)[:-1]):
                n = size[of]
                ends = np.cumsum(n)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[of] - ends + n, n)
                out.append(ids[at].astype("<u4").tobytes())
        found = {"doc_id": pd.array(docs, "Int64"), "ids": out}
        if look_up:
            found["bytes"] = [b for at in range(0, len(out), _SLICE_ROWS) for b in look_up(out[at : at + _SLICE_ROWS]).to_pylist()]
        return pd.DataFrame(found)

    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInPandas(assemble, "doc_id long, ids binary" + ", bytes binary" * decoded)


def _look_up(ranks: bytes) -> Callable[[list[bytes]], pa.Array]:
    """Makes the bytes of the tokens of each row's ids; a worker reads the table of tokens once."""
    held = []

    def look_up(ids: list[bytes]) -> pa.Array:
        if not held:
            table = read_ranks(ranks)
            tokens = [b""] * (max(table.values(), default=-1) + 1)
            for token, rank in table.items():
                tokens[rank] = token
            held.append(pa.array(tokens, pa.binary()))
        of_tokens = held[0].take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        ends = np.r_[0, np.cumsum([len(x) // 4 for x in ids])]
        starts = np.frombuffer(of_tokens.buffers()[1], np.int32)[of_tokens.offset :][ends].astype(np.int32) if len(of_tokens) else np.zeros(len(ends), np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(starts.tobytes()), of_tokens.buffers()[2] or pa.py_buffer(b"")])

    return look_up


def decode(encoded: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, bytes): the bytes of the ids' tokens.  Null ids give no bytes."""
    look_up = _look_up(ranks)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):  # so that few texts are held at once
                part = batch.slice(at, _SLICE_ROWS)
                found = look_up([x or b"" for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), found], ["doc_id", "ids", "bytes"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decoded, "doc_id long, ids binary, bytes binary")
