"""Stateful operators over event tables, as batch plans and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW_S, IDLE_S, CACHE_S = 60, 1800, 600


def sliding_counts(events: DataFrame, seconds: int = WINDOW_S, by: str = "user_id", ts: str = "ts") -> DataFrame:
    """in_window: events of the same user in (ts - seconds, ts], each event itself included (recorded before it is judged)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(by).orderBy("_t").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("_t", micros).withColumn("in_window", F.count(F.lit(1)).over(w)).drop("_t")


def sessions(events: DataFrame, idle: int = IDLE_S, by: str = "user_id", ts: str = "ts") -> DataFrame:
    """session number of each event: a new one starts when the user was idle for more than `idle` seconds."""
    w = Window.partitionBy(by).orderBy("_t", "event_id")
    t = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    fresh = (F.col("_t") - F.lag("_t").over(w)) > idle * 1_000_000
    return t.withColumn("_f", F.coalesce(fresh.cast("int"), F.lit(1))).withColumn("session", F.sum("_f").over(w)).drop("_t", "_f")


def stream_sessions(stream: DataFrame, delay: str = "1 hour", idle: str = "30 minutes") -> DataFrame:
    """Session windows of a stream of events, with a watermark for late ones."""
    kept = stream.withWatermark("ts", delay)
    return kept.groupBy("user_id", F.session_window("ts", idle)).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))


def stream_once(stream: DataFrame, key: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: an idempotency cache with a lifetime."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
