"""Bursts of activity separated by idle gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_MS = 300_000


def sessionize(events: DataFrame, user: str = "user_id", at_ms: str = "at_ms", event_id: str | None = None, gap_ms: int = GAP_MS) -> DataFrame:
    """One row per session: ``user, start_ms, end_ms, duration_ms, n_events``.

    Every event opens an interval of ``gap_ms``; intervals of one user that touch merge (events exactly ``gap_ms`` apart
    are one session). With ``event_id``, repeated copies of an event count once; rows without an id count each.
    Rows whose user is null or empty, or whose time is null, belong to no session. An empty table gives an empty result.

    Interval states merge twice. Events of one user in the same slot of ``gap_ms`` always touch, so each map task first
    merges them to one state per slot; only states are shuffled. The second merge, over all states of a user, then has
    at most one state per slot of the time covered, whatever share of the rows the user holds.
    """
    rows = events.select(
        F.nullif(F.col(user), F.lit("")).alias("u"), F.col(at_ms).cast("bigint").alias("t"), *([F.col(event_id).alias("i")] if event_id else [])
    ).where("u is not null and t is not null")
    if event_id:
        rows = rows.groupBy("u", "t", "i").agg(F.count(F.lit(1)).alias("c")).withColumn("c", F.expr("if(i is null, c, 1)"))
    else:
        rows = rows.withColumn("c", F.lit(1).cast("bigint"))
    slots = rows.groupBy("u", F.floor(F.col("t") / F.lit(gap_ms)).alias("slot")).agg(F.min("t").alias("s"), F.max("t").alias("e"), F.sum("c").alias("c"))
    # A state reaches a gap beyond its end; half a millisecond more lets touching ends merge and no others.
    reach = F.concat((F.col("e") - F.col("s") + F.lit(gap_ms)).cast("string"), F.lit(" milliseconds 500 microseconds"))
    return (
        slots.groupBy("u", F.session_window(F.timestamp_millis("s"), reach))
        .agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), F.sum("c").alias("n_events"))
        .select(F.col("u").alias(user), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events")
    )


def sessionize_stream(events: DataFrame, user: str, at: str, gap_ms: int = GAP_MS, late: str = "10 days", event_id: str | None = None) -> DataFrame:
    """The same over a stream with a timestamp column ``at``: ``user, start_ms, end_ms, duration_ms, n_events``.

    Interval states are kept per user until the watermark, ``late`` behind the newest event, has passed their end; an
    event that late or less still joins, or joins together, the sessions it touches. Later ones are left out. With
    ``event_id``, repeated copies of an event (same user, time and id) count once, and ids are kept as long; rows without
    an id count each. Interval states of a batch merge before the shuffle if the session's setting
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is true.
    """
    rows = events.where(F.nullif(F.col(user), F.lit("")).isNotNull()).withWatermark(at, late)
    if event_id:
        rows = rows.where(F.col(event_id).isNotNull()).dropDuplicates([user, at, event_id]).unionByName(rows.where(F.col(event_id).isNull()))
    return (
        rows.groupBy(user, F.session_window(at, f"{gap_ms} milliseconds 500 microseconds"))
        .agg(F.min(F.unix_millis(at)).alias("start_ms"), F.max(F.unix_millis(at)).alias("end_ms"), F.count(F.lit(1)).alias("n_events"))
        .select(user, "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events")
    )
