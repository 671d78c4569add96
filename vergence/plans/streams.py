"""Replays of the telemetry through streams with state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.plans.more import SQL, query
from vergence.sources import views
from vergence.sources.views import AS_OF
from vergence.streaming import limiter, stateful

#: Admissions of a user in so many seconds; bounds of the histogram; minutes that a session's token lives.
LIMIT, WINDOW_S, BOUNDS, MINUTES = 3, 21600, (0.5, 1.0, 5.0, 20.0), 60 * 24 * 10

# The rule of the limiter, event by event: the admitted times within the window are carried along.
LIMITED = f"""with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
    r as (select event_id, user_id, n, [us] as held, true as admitted, 0 as retry_after from e where n = 1
        union all select e.event_id, e.user_id, e.n, case when len(w.live) < {LIMIT} then list_append(w.live, e.us) else w.live end, len(w.live) < {LIMIT},
            case when len(w.live) < {LIMIT} then 0 else greatest(1, ceil(({WINDOW_S}000000 - (e.us - w.live[1])) / 1e6)::int) end
        from r join e on e.user_id = r.user_id and e.n = r.n + 1, lateral (select list_filter(r.held, lambda t: t > e.us - {WINDOW_S}000000) as live) w)
    select event_id as id, user_id as key, admitted, retry_after from r"""
SQL["rate_limiter"] = LIMITED


@query(LIMITED)
def streamed_limits(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on every event by a stream whose state outlives restarts; the same as rate_limiter's."""
    return stateful.replay(views.telemetry(spark, d), "ts", lambda s: stateful.limited_by_state(s, "user_id", "ts", "event_id", LIMIT, float(WINDOW_S)))


@query("select event_type, " + ", ".join(f"count(*) filter (value <= {b}) as le_{i}" for i, b in enumerate(BOUNDS)) + ", count(value) as n, round(sum(value), 4) as total from events group by event_type")
def streamed_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative counts of values at each bound, carried on by a stream over all slices of the events."""
    found = stateful.replay(views.telemetry(spark, d), "ts", lambda s: limiter.latency_buckets(s, "value", "event_type", BOUNDS), mode="complete")
    return found.withColumn("total", F.round("total", 4))


@query("select from_status, to_status, count(*) as n from (select lag(event_type) over (partition by user_id order by ts, event_id) as from_status, event_type as to_status from events) where from_status is not null group by 1, 2")
def streamed_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How often a user's state passes from one kind of event to another, counted by a stream."""
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    changes = views.telemetry(spark, d).select("ts", before.alias("from_status"), F.col("event_type").alias("to_status")).where("from_status is not null")
    return stateful.replay(changes, "ts", limiter.transitions, mode="complete")


@query(f"select event_id, user_id from events where event_type <> 'error' and ts + interval {MINUTES} minutes > timestamp '{AS_OF}'")
def usable_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Sessions begun by events whose token hasn't expired; those of errors have no end and so no use."""
    expires = F.when(F.col("event_type") != "error", F.col("ts") + F.expr(f"interval {MINUTES} minutes"))
    return limiter.usable_tokens(views.telemetry(spark, d).withColumn("expires_at", expires), F.lit(AS_OF).cast("timestamp")).select("event_id", "user_id")
