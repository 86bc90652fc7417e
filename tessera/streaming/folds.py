"""Folds over each key's events in order, where a decision depends on earlier decisions.

Events are dealt by key and sorted in each task; the fold streams over Arrow batches and holds only the current key's
state (one time, or as many as the limit), so a key of any size needs bounded memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(events: DataFrame, by: str, order: str, fresh: Callable, step: Callable, column: str) -> DataFrame:
    """events with a boolean column: step(state, micros) of each event, the state renewed by fresh() at each key."""

    def run(batches: Iterator):
        key, state, started = None, None, False
        for b in batches:
            out = []
            for k, t in zip(b[by].tolist(), b["_t"].tolist(), strict=True):
                if not started or k != key:
                    key, state, started = k, fresh(), True
                out.append(step(state, t))
            b[column] = out
            yield b.drop(columns="_t")

    rows = events.filter(F.col(by).isNotNull() & F.col("ts").isNotNull()).withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema)}, `{column}` boolean"
    return rows.repartition(F.col(by)).sortWithinPartitions(by, "_t", order).mapInPandas(run, schema)


def rate_limit(events: DataFrame, limit: int, seconds: int = 60, by: str = "user_id", order: str = "event_id") -> DataFrame:
    """allowed: fewer than `limit` allowed events of the key in (ts - seconds, ts). Rejected events are not recorded.

    Events without a key or time are left out.
    """
    span = seconds * 1_000_000

    def step(kept: deque, t: int) -> bool:
        while kept and kept[0] <= t - span:
            kept.popleft()
        if len(kept) >= limit:
            return False
        kept.append(t)
        return True

    return _fold(events, by, order, deque, step, "allowed")


def idempotent(events: DataFrame, seconds: int = 600, by: str = "user_id", order: str = "event_id") -> DataFrame:
    """stored: the event was carried out and stored; else a stored result at most `seconds` old answered it."""
    span = seconds * 1_000_000

    def step(last: list, t: int) -> bool:
        if last and t - last[0] <= span:
            return False
        last[:] = [t]
        return True

    return _fold(events, by, order, list, step, "stored")


def latest_readable(checkpoints: DataFrame, by: str, version: str, payload: str, keep: int = 3) -> DataFrame:
    """(by, version, fell_back): the newest of the last `keep` versions whose payload is readable JSON."""
    from pyspark.sql.window import Window

    last = checkpoints.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(version)))).filter(F.col("_n") <= keep)
    ok = last.filter(F.try_parse_json(F.col(payload)).isNotNull())
    return ok.groupBy(by).agg(F.min_by(F.struct(version, (F.col("_n") > 1).alias("fell_back")), "_n").alias("r")).select(by, "r.*")


def span_tree(log: DataFrame) -> DataFrame:
    """(span_id, parent_id, n_events, failed, n_children) of log(span_id, parent_id, level): failed if any event is an ERROR."""
    spans = log.groupBy("span_id").agg(F.first("parent_id", ignorenulls=True).alias("parent_id"), F.count(F.lit(1)).alias("n_events"), F.max(F.col("level") == "ERROR").alias("failed"))
    kids = spans.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("span_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return spans.join(kids, "span_id", "left").na.fill({"n_children": 0})
