"""Dashboards and telemetry: zero-filled days, rates, satisfaction, percentiles and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of the dashboard's window, and bounds of the latency histogram in seconds.
WINDOW_DAYS = 7
BOUNDS = (0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0)


def half_up(x: Column) -> Column:
    """One decimal, halves up."""
    return F.floor(x * 10 + 0.5) / 10


def window_start(as_of: str, days: int = WINDOW_DAYS) -> Column:
    return F.date_trunc("DAY", F.lit(as_of).cast("timestamp") - F.expr(f"interval {days - 1} days"))


def daily(events: DataFrame, ts: str, as_of: str, counted: dict[str, Column], days: int = WINDOW_DAYS) -> DataFrame:
    """(day, one column for each condition): every day of the window in ascending order, with zeros."""
    start = window_start(as_of, days)
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(start.cast("date"), F.lit(as_of).cast("timestamp").cast("date"))).alias("day"))
    counts = events.where(F.col(ts) >= start).groupBy(F.to_date(ts).alias("day")).agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    return spine.join(counts, "day", "left").na.fill(0, list(counted)).orderBy("day")


def rate(part: Column, whole: Column) -> Column:
    """Null without a numerator."""
    return F.when(part > 0, part / whole)


def satisfaction(ratings: DataFrame, score: str) -> DataFrame:
    """(score, n, share_of_all, average): all five scores, even without ratings; others don't count."""
    valid = ratings.where(F.col(score).between(1, 5)).groupBy(F.col(score).cast("int").alias("score")).agg(F.count("*").alias("n"))
    spine = ratings.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("score"))
    filled = spine.join(valid, "score", "left").na.fill(0, ["n"])
    average = valid.agg(F.try_divide(F.sum(F.col("n") * F.col("score")), F.sum("n")).alias("average")).scalar()
    return filled.select("score", "n", half_up(average).alias("average"))


def latency(samples: DataFrame, value: str, failed: Column, by: list[str]) -> DataFrame:
    """(by, n, p50, p95, p99, error_rate) with linearly interpolated percentiles."""
    cut = lambda p: F.percentile(value, F.lit(p)).alias(f"p{round(p * 100)}")
    return samples.groupBy(*by).agg(F.count("*").alias("n"), cut(0.5), cut(0.95), cut(0.99), (F.count_if(failed) / F.count("*")).alias("error_rate"))


def histogram(samples: DataFrame, value: str, by: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(by, bound, n): cumulative counts at each bound and, at infinity, of all."""
    counts = samples.groupBy(by).agg(*[F.count_if(F.col(value) <= b).alias(str(i)) for i, b in enumerate(bounds)], F.count(value).alias("all"))
    rows = F.array(*[F.struct(F.lit(b).alias("bound"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("bound"), F.col("all").alias("n")))
    return counts.select(by, F.explode(rows).alias("row")).select(by, "row.bound", "row.n")


def facets(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))
