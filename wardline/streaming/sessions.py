"""Activity sessions by idle timeout, and sessions of fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from wardline.functions.dates import AsOf, stamp

# Minutes without activity that end a session; length of a fixed session.
IDLE_MINUTES = 60
FIXED_MINUTES = 30

_IDLE = IDLE_MINUTES * 60 * 1_000_000


def activity_sessions(events: DataFrame) -> DataFrame:
    """Sessions per user: a pause of 60 minutes or more starts a new one.

    Events within one aligned hour are always less than 60 minutes apart, so each (user, hour) is one
    partial session, found by plain aggregation. What is left to order per user is one row per active
    hour, however many events there are.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    hours = (
        events.select("user_id", at.alias("_at"))
        .groupBy("user_id", F.floor(F.col("_at") / F.lit(_IDLE)).alias("_hour"))
        .agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count("*").alias("_n"))
    )
    per_user = W.partitionBy("user_id").orderBy("_hour")
    starts = F.coalesce(F.col("_from") - F.lag("_to").over(per_user) >= _IDLE, F.lit(True))
    numbered = hours.withColumn("_starts", starts.cast("int")).withColumn("session_no", F.sum("_starts").over(per_user))
    return (
        numbered.groupBy("user_id", "session_no")
        .agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("events"))
        .select(
            "user_id",
            F.col("session_no").cast("long").alias("session_no"),
            F.timestamp_micros("_from").cast("timestamp_ntz").alias("started_at"),
            F.timestamp_micros("_to").cast("timestamp_ntz").alias("last_activity"),
            "events",
        )
    )


def activity_session_stream(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """The same over a stream. The gap is a microsecond short of an hour because session windows that
    touch are merged, and a pause of exactly 60 minutes has to split. Where
    spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition is set, sessions are merged inside
    each task before the shuffle, so that a very active user sends sessions and not events."""
    gap = "59 minutes 59 seconds 999999 microseconds"
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.count("*").alias("events"))
        .select(
            "user_id",
            F.col("_from").cast("timestamp_ntz").alias("started_at"),
            F.col("_to").cast("timestamp_ntz").alias("last_activity"),
            "events",
        )
    )


def fixed_sessions(sessions: DataFrame, *, as_of: AsOf) -> DataFrame:
    """sessions: session_id, user_id, created_at. Expiry 30 minutes after creation, open until then."""
    expires = F.col("created_at") + F.expr(f"interval {FIXED_MINUTES} minutes")
    return sessions.select(
        "session_id", "user_id", "created_at", expires.alias("expires_at"), (expires > stamp(as_of)).alias("is_active")
    )
