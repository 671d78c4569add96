"""Token counts by a transducer compiled from a BPE piece model.

The tokens of a text follow from those of its prefixes: exactly one token ends at each position
whose left neighbour, the token that ends where it starts, stays apart from it when the two are
encoded together.  So reading one character moves between finitely many states, each the longest
suffix that may still grow into a piece with the last token and the relative count at each of its
positions, and the transition carries the change in the number of tokens.  States are compiled
when first reached.  A space after another character and a line feed lead back to the start
state, so a chunk of a text maps any state to a state and a count by its head, the count of its
inner part and its tail; such maps compose associatively and are folded as a balanced tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 1 << 16
#: Most transitions, and most words, that a worker process holds; beyond it starts anew.
_KEPT_MOVES, _KEPT_WORDS = 600_000, 300_000
_SPACE = "▁"
_NORMAL, _USER, _BYTE = 1, 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) pairs of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a sentencepiece model file."""
    import struct

    pieces = []
    for number, value in _fields(model):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, _NORMAL)))
    return pieces


class Transducer:
    """Counts the tokens of segments; transitions are compiled when first taken."""

    def __init__(self, model: bytes):
        pieces = read_pieces(model)
        self.score = {p: s for p, s, kind in pieces if kind in (_NORMAL, _USER)}
        self.bytes = any(kind == _BYTE for _, _, kind in pieces)
        self.starts = {p[:i] for p in self.score for i in range(1, len(p) + 1)}
        self.clear()
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in self.score):
            raise ValueError("pieces that cross a space or a line feed are not supported")

    def clear(self) -> None:
        self.states: list[tuple[str, tuple]] = [("", (("", 0),))]  # suffix; (last token, count less the newest) from its start on
        self.known = {self.states[0]: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self._apart: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces by repeatedly joining the neighbours whose joint piece has the best score."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max(((self.score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score), default=(0.0, 1))
            if at > 0:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """The two tokens side by side are what their text is encoded as."""
        if (held := self._apart.get((left, right))) is None:
            self._apart[left, right] = held = self.merged(left + right) == ([left, right] if left else [right])
        return held

    def _move(self, state: int, char: str) -> tuple[int, int]:
        if char not in self.score:  # one token for each byte, or one unknown; nothing merges with it
            return 0, len(char.encode("utf-8", "surrogatepass")) if self.bytes else 1
        suffix, past = self.states[state]
        text, token, now = suffix + char, None, 0
        for i, (last, count) in enumerate(past):
            if (piece := text[i:]) in self.score and self.apart(last, piece):
                token, now = piece, count + 1
                break
        if token is None:
            raise ValueError(f"no token ends after {text!r}")
        past = (*past, (token, now))
        while text and text not in self.starts:
            text, past = text[1:], past[1:]
        key = (text, tuple((t, c - now) for t, c in past))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key], now

    def segment(self, text: str) -> int:
        """The tokens of a text that starts in the start state; spaces are written as in the pieces."""
        if len(self.moves) > _KEPT_MOVES:
            self.clear()
        state = total = 0
        for char in text:
            if (move := self.moves.get((state, char))) is None:
                self.moves[state, char] = move = self._move(state, char)
            state, change = move
            total += change
        return total


class _Counts(dict):
    """Counts of words, with a prefix before each."""

    def __init__(self, transducer: Transducer, prefix: str):
        self.transducer, self.prefix = transducer, prefix

    def __missing__(self, word: str) -> int:
        n = self.transducer.segment(self.prefix + word)
        if len(word) < 64:
            if len(self) > _KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


_HEAD, _TAIL, _PARTS = re.compile(r" *[^ \n]*"), re.compile(r" *[^ \n]*\Z"), re.compile(r" +[^ ]*|[^ ]+")


class Counter:
    def __init__(self, model: bytes):
        self.transducer = Transducer(model)
        self.spaced, self.plain = _Counts(self.transducer, _SPACE), _Counts(self.transducer, "")
        self.feed = self.transducer.segment("\n")

    def span(self, text: str) -> int:
        """The tokens of a text between two places where the start state is reached."""
        lines = text.split("\n")
        total = self.feed * (len(lines) - 1)
        for line in lines:
            words = line.split(" ")
            if "" not in words[1:]:
                total += sum(map(self.spaced.__getitem__, words[1:]))
                if words[0]:
                    total += self.plain[words[0]]
            else:
                total += sum(self.transducer.segment(p.replace(" ", _SPACE)) for p in _PARTS.findall(line))
        return total

    def chunk(self, text: str) -> tuple[str, int, str | None]:
        """A chunk's map: head, count of the inner part, tail; no tail if the start state isn't reached in it."""
        head = _HEAD.match(text)[0]
        if len(head) == len(text):
            return head, 0, None
        cut = len(text)
        while cut > len(head) and text[cut - 1] not in " \n":
            cut -= 1
        while cut > len(head) and text[cut - 1] == " ":
            cut -= 1
        return head, self.span(text[len(head) : cut]), text[cut:]

    def compose(self, x: tuple, y: tuple) -> tuple:
        if x[2] is None:
            return x[0] + y[0], y[1], y[2]
        if y[2] is None:
            return x[0], x[1], x[2] + y[0]
        return x[0], x[1] + self.span(x[2] + y[0]) + y[1], y[2]

    def count(self, text: str | None, chunk_chars: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        text = " " + text.replace(_SPACE, " ")
        maps = [self.chunk(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.span(head) + n + (self.span(tail) if tail else 0)


_COUNTERS: dict[bytes, Counter] = {}


def _counter(model: bytes) -> Counter:
    """One for each worker process, so that what is compiled serves all its tasks."""
    if model not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[model] = Counter(model)
    return _COUNTERS[model]


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of docs, whole texts.

    model: the bytes of the model file, whose size the vocabulary bounds.  A null text counts as
    empty, with no bytes and no tokens.  Repeated rows and null ids are counted like any other;
    other columns are ignored; an empty table gives no rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": [counter.count(t) for t in pdf["text"]]})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInPandas(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
