"""Event analytics, batch and Structured Streaming: sessions, windows, duplicates, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """user, start, n: a session ends after a gap of inactivity."""
    return events.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), "n")


def tumbling(events: DataFrame, width: str, keys: list[str], ts: str = "ts", slide: str | None = None) -> DataFrame:
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def first_seen(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """One row per user: an insert that ignores what is there already."""
    return events.groupBy(user).agg(F.min(ts).alias("first_ts"))


def sanitised(events: DataFrame, kinds: list[str], most: int = 40) -> DataFrame:
    """Trimmed and cut properties, empty ones null, unknown kinds as other."""
    props = F.nullif(F.substring(F.trim(F.coalesce("props", F.lit(""))), 1, most), F.lit(""))
    return events.select("event_id", F.when(F.col("event_type").isin(kinds), F.col("event_type")).otherwise("other").alias("kind"), props.alias("props"))


def running_users(events: DataFrame, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """day, new_users, users_so_far: days are few, so the running sum over them is small."""
    days = first_seen(events, user, ts).groupBy(F.to_date("first_ts").alias("day")).agg(F.count("*").alias("new_users"))
    return days.withColumn("users_so_far", F.sum("new_users").over(W.partitionBy(F.lit(0)).orderBy("day")))


def stream_sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    return sessions(events.withWatermark("ts", late), gap=gap)


def stream_tumbling(events: DataFrame, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return tumbling(events.withWatermark("ts", late), width, keys)


def stream_unique(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Appends idempotent by key."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
