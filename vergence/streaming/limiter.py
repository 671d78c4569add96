"""The sliding-window limiter and counters on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vergence.operators.limits import LIMIT, WINDOW_S, Limiter


def limited_stream(events: DataFrame, key: str, ts: str, id_col: str, limit: int = LIMIT, window: float = WINDOW_S, late: str = "10 minutes") -> DataFrame:
    """(id, key, admitted, retry_after) of a stream; the state of a key is its admitted times and goes once they have left the window.

    Events of one batch are taken in the order of time and id; one that arrives in a later batch is judged by the state it finds."""
    rows = events.select(F.col(id_col).cast("long").alias("id"), F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["at", "id"])
        limiter, out = Limiter(limit, window, held), []
        for i, at in zip(pdf["id"], pdf["at"]):
            out.append((i, k[0], *limiter.ask(at.timestamp())))
        state.update((list(limiter.admitted),))
        last = int(max(limiter.admitted, default=0) * 1000 + window * 1000) + 1
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "key", "admitted", "retry_after"])

    return rows.groupBy("key").applyInPandasWithState(decide, "id long, key long, admitted boolean, retry_after int", "admitted array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, counted: dict[str, Column], every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, one column for each condition) of tumbling windows, given out once the watermark has passed them."""
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.window("_at", every).alias("w")).agg(*[F.count_if(c).alias(n) for n, c in counted.items()]).select(F.col("w.start").alias("start"), *counted)


def transitions(changes: DataFrame) -> DataFrame:
    """Running counts of (from_status, to_status)."""
    return changes.groupBy("from_status", "to_status").agg(F.count("*").alias("n"))


def latency_buckets(samples: DataFrame, value: str, by: str, bounds: tuple[float, ...]) -> DataFrame:
    """Running cumulative counts at each bound."""
    return samples.groupBy(by).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)], F.count(value).alias("n"), F.sum(value).alias("total"))


def usable_tokens(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions whose token has an end that isn't past; no end means no use."""
    return sessions.where(F.col("expires_at").isNotNull() & (F.col("expires_at") > now))
