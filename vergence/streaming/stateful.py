"""The sliding-window limiter on keyed state with timers, and replays of tables through streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vergence.operators.limits import LIMIT, WINDOW_S, Limiter

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DECISIONS = "id long, key long, admitted boolean, retry_after int"


class LimitProcessor(StatefulProcessor):
    """Keeps the admitted times of a key as a list, and a timer that drops them once they have left the window."""

    def __init__(self, limit: int = LIMIT, window: float = WINDOW_S):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("admitted", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "id"])
        limiter = Limiter(self.limit, self.window, [r[0] for r in self.times.get()])
        asked = [(i, key[0], *limiter.ask(at.timestamp())) for i, at in zip(pdf["id"], pdf["at"])]
        self._keep(list(limiter.admitted), timerValues)
        yield pd.DataFrame(asked, columns=["id", "key", "admitted", "retry_after"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        self._keep([r[0] for r in self.times.get() if r[0] > now - self.window], timerValues)
        return iter(())

    def _keep(self, times: list[float], timerValues) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if not times:
            self.times.clear()
            return
        self.times.put([(t,) for t in times])
        due = int((max(times) + self.window) * 1000) + 1
        self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def limited_by_state(events: DataFrame, key: str, ts: str, id_col: str, limit: int = LIMIT, window: float = WINDOW_S, late: str = "10 minutes") -> DataFrame:
    """(id, key, admitted, retry_after) of a stream, as `operators.limits.limited` gives them for a table in the order of time.

    The state of a key is at most `limit` times; an event-time timer empties it once the watermark
    has passed the window of the last one.  Events of one batch are taken in the order of time and
    id, and one task holds those of one key; rows behind the watermark are dropped, null keys are
    one key and null times are left out."""
    rows = events.select(F.col(id_col).cast("long").alias("id"), F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("at")).where("at is not null").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(LimitProcessor(limit, window), _DECISIONS, "Append", "eventTime")


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only where the session names none."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    return f"{top}/replay-{uuid.uuid4().hex}"


def replay(rows: DataFrame, ts: str, through: Callable[[DataFrame], DataFrame], slices: int = 3, mode: str = "append") -> DataFrame:
    """The rows that a stream of the table gives in all, fed to it in slices of time of about equal counts.

    Each slice is written to the shared folder, and the query is started anew from its checkpoint
    for it, so that its state has to survive restarts.  In mode `complete` the last batch's rows
    are the result.  Times are the only order: rows of a null time are left out."""
    spark, top = rows.sparkSession, _shared(rows.sparkSession)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    bounds = rows.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000)).first()[0] if slices > 1 else []
    edges = [None, *sorted(set(bounds or [])), None]
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        for n, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
            part = rows.where(at.isNotNull())
            part = part if low is None else part.where(at > low)
            (part if high is None else part.where(at <= high)).write.mode("append").parquet(f"{top}/in")
            out = through(spark.readStream.schema(rows.schema).parquet(f"{top}/in"))
            writer = out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{top}/state").outputMode(mode)
            if mode == "append":
                started = writer.format("parquet").option("path", f"{top}/out").start()
            else:
                started = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{top}/out-{n}")).start()  # noqa: B023
            started.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return spark.read.schema(out.schema).parquet(f"{top}/out" if mode == "append" else f"{top}/out-{n}")
