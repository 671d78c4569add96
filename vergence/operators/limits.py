"""Stateful operators: the sliding-window limiter and segmentation by pauses, as batch jobs over keys."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Admitted events of a key within a window of seconds; pause and span that start a segment.
LIMIT, WINDOW_S, PAUSE_S, SPAN_S = 5, 3600.0, 1.2, 20.0


class Limiter:
    """Admits an event if fewer than `limit` admitted ones lie in the window before it."""

    def __init__(self, limit: int = LIMIT, window: float = WINDOW_S, admitted: list[float] | None = None):
        self.limit, self.window, self.admitted = limit, window, deque(admitted or [])

    def ask(self, now: float) -> tuple[bool, int]:
        """(admitted, seconds to wait)."""
        while self.admitted and self.admitted[0] <= now - self.window:
            self.admitted.popleft()
        if len(self.admitted) < self.limit:
            self.admitted.append(now)
            return True, 0
        return False, max(1, math.ceil(self.window - (now - self.admitted[0])))


def limited(events: DataFrame, key: str, ts: str, id_col: str, limit: int = LIMIT, window: float = WINDOW_S) -> DataFrame:
    """(id, key, admitted, retry_after): every event in the order of time and id.

    The events of a key stream through its partition in batches, sorted; the state of one key is
    at most `limit` times, and no key's events are held together."""
    rows = events.select(F.col(id_col).cast("long").alias("id"), F.col(key).cast("long").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    ordered = rows.repartition(F.col("key")).sortWithinPartitions("key", "at", "id")

    def decide(batches):
        last, state = None, Limiter(limit, window)
        for pdf in batches:
            out = []
            for i, k, at in zip(pdf["id"], pdf["key"], pdf["at"]):
                if k != last:
                    last, state = k, Limiter(limit, window)
                out.append((i, k, *state.ask(at / 1e6)))
            yield pd.DataFrame(out, columns=["id", "key", "admitted", "retry_after"])

    return ordered.mapInPandas(decide, "id long, key long, admitted boolean, retry_after int")


def segments(rows: DataFrame, key: str, start: str, end: str, pause: float = PAUSE_S, span: float = SPAN_S) -> DataFrame:
    """(key, segment, started, ended, n): a new segment after a pause or once the segment spans so many seconds.

    The span starts anew with each segment, so this is state and no plain window; partitions stream in order."""
    ordered = rows.select(F.col(key).cast("long").alias("key"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")).repartition(F.col("key")).sortWithinPartitions("key", "s", "e")

    def cut(batches):
        last, n, held = None, 0, None
        for pdf in batches:
            out = []
            for k, s, e in zip(pdf["key"], pdf["s"], pdf["e"]):
                if k != last:
                    out += [held] if held else []
                    last, n, held = k, 0, None
                if held and (s - held[3] >= pause or held[3] - held[2] >= span):
                    out.append(held)
                    n, held = n + 1, None
                held = (k, n, held[2] if held else s, max(e, held[3]) if held else e, (held[4] if held else 0) + 1)
            yield pd.DataFrame(out, columns=["key", "segment", "started", "ended", "n"])
        if held:
            yield pd.DataFrame([held], columns=["key", "segment", "started", "ended", "n"])

    return ordered.mapInPandas(cut, "key long, segment int, started double, ended double, n int")


def merged_evenly(rows: DataFrame, by: str, order: str, cap: int) -> DataFrame:
    """(by, bucket, n, first): at most `cap` even buckets of consecutive rows."""
    nth = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    total = F.count("*").over(W.partitionBy(by))
    bucket = F.when(total <= cap, nth).otherwise(F.floor(nth * cap / total)).cast("int")
    return rows.select(by, order, bucket.alias("bucket")).groupBy(by, "bucket").agg(F.count("*").alias("n"), F.min(order).alias("first"))
