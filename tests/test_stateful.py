"""The limiter on keyed state, and replays, against the operators on tables."""

import random

from vergence.operators import limits
from vergence.streaming import limiter, stateful


def _events(spark, rows):
    return spark.createDataFrame(rows, "id long, user long, at string").selectExpr("id", "user", "cast(at as timestamp) as at")


def _time(seconds):
    return f"2024-01-01 {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def test_replayed_limits_equal_those_of_the_table(spark):
    rng = random.Random(7)
    rows = [(i, 1 if i % 3 == 0 else rng.randint(2, 5), _time(rng.randint(0, 900))) for i in range(240)] + [(240, 9, None), (241, None, _time(5)), (242, None, _time(6))]
    events = _events(spark, rows)
    got = stateful.replay(events, "at", lambda s: stateful.limited_by_state(s, "user", "at", "id", limit=3, window=60.0))
    expected = limits.limited(events.where("at is not null"), "user", "at", "id", limit=3, window=60.0)
    rows_of = lambda df: sorted((r["id"], r["key"] or -1, r["admitted"], r["retry_after"]) for r in df.collect())
    assert rows_of(got) == rows_of(expected) and got.where("not admitted").count() > 20


class _Timers:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.watermark


class _Handle:
    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, due):
        self.timers.remove(due)

    def registerTimer(self, due):
        self.timers.append(due)


def test_a_timer_empties_the_state():
    import pandas as pd

    handle, processor = _Handle(), stateful.LimitProcessor(limit=2, window=60.0)
    processor.init(handle)
    pdf = pd.DataFrame({"id": [1, 2, 3], "at": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:20"])})
    out = pd.concat(processor.handleInputRows((7,), iter([pdf]), _Timers(0)))
    assert out["admitted"].tolist() == [True, True, False] and out["retry_after"].tolist() == [0, 0, 40]
    assert len(handle.rows) == 2 and len(handle.timers) == 1
    assert list(processor.handleExpiredTimer((7,), _Timers(handle.timers[0]), _Timers(handle.timers[0]))) == []
    assert handle.rows == [] and handle.timers == []


def test_replayed_counts(spark):
    samples = spark.createDataFrame([(i, f"k{i % 2}", float(i), _time(i)) for i in range(30)], "id long, kind string, value double, at string").selectExpr("id", "kind", "value", "cast(at as timestamp) as at")
    got = stateful.replay(samples, "at", lambda s: limiter.latency_buckets(s, "value", "kind", (5.0, 50.0)), mode="complete")
    assert sorted((r["kind"], r["le_0"], r["le_1"], r["n"]) for r in got.collect()) == [("k0", 3, 15, 15), ("k1", 3, 15, 15)]


def test_empty_table(spark):
    assert stateful.replay(_events(spark, []), "at", lambda s: stateful.limited_by_state(s, "user", "at", "id")).count() == 0
