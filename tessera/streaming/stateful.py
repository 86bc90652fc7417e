"""Folds over each key's events as streams: rate limits, idempotency and state machines that go on from a checkpoint.

A stream brings a key's events in any order. They wait in the key's state until the watermark has passed them, so that no
earlier one can come; then they are folded in order of time. A timer wakes the key for its next event, and one more when
what it remembers can no longer matter: then the state is removed. So a stream gives the rows that the batch form of the
fold (`folds`, `states`) gives over all events, however they were cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.states import MOVES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Fold:
    """What a key remembers, and what an event does to it.

    memory: schema of what is remembered; fresh: its value before the first event; step(memory, micros, value) gives the
    new memory and the event's result columns; until(memory): the micros after which the memory is worth nothing, or None.
    """

    memory: str
    fresh: tuple
    step: Callable[[tuple, int, str | None], tuple[tuple, tuple]]
    results: str
    until: Callable[[tuple], int | None]


def rate_limit(limit: int, seconds: int = 60) -> Fold:
    """allowed: fewer than `limit` allowed events in (ts - seconds, ts]; a rejected one is not recorded."""
    span = seconds * 1_000_000

    def step(memory: tuple, t: int, _: str | None) -> tuple[tuple, tuple]:
        kept = [x for x in memory[0] if x > t - span]
        ok = len(kept) < limit
        return ([*kept, t] if ok else kept,), (ok,)

    return Fold("kept array<long>", ([],), step, "allowed boolean", lambda m: max(m[0], default=0) + span)


def idempotent(seconds: int = 600) -> Fold:
    """stored: the event was carried out; else a result at most `seconds` old answered it."""
    span = seconds * 1_000_000

    def step(memory: tuple, t: int, _: str | None) -> tuple[tuple, tuple]:
        fresh = memory[0] is None or t - memory[0] > span
        return (t if fresh else memory[0],), (fresh,)

    return Fold("last long", (None,), step, "stored boolean", lambda m: (m[0] or 0) + span)


def machine(first: str = "RECEIVED", moves: dict[str, tuple[str, ...]] = MOVES) -> Fold:
    """after, accepted: the state that the value's move leaves, and whether the move was legal. It is remembered for good."""

    def step(memory: tuple, _: int, want: str | None) -> tuple[tuple, tuple]:
        ok = want in moves.get(memory[0], ())
        now = want if ok else memory[0]
        return (now,), (now, ok)

    return Fold("state string", (first,), step, "after string, accepted boolean", lambda m: None)


class InOrder(StatefulProcessor):
    """Events of a key wait for the watermark, then go through the fold in order of (micros, nth)."""

    def __init__(self, fold: Fold, by: str):
        self.fold, self.by = fold, by
        self.names = [part.split()[0] for part in fold.results.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "t long, nth long, value string")
        self.memory = handle.getValueState("memory", self.fold.memory)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [x for b in rows for x in zip(b["fold_t"].tolist(), b["fold_nth"].tolist(), b["fold_value"].tolist(), strict=True)]
        self.pending.appendList(new)
        self._wake(min(t for t, _, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, waiting = timerValues.getCurrentWatermarkInMs() * 1000, [tuple(x) for x in self.pending.get()]
        due, later = sorted((x for x in waiting if x[0] <= now), key=lambda x: x[:2]), [x for x in waiting if x[0] > now]
        memory = tuple(self.memory.get()) if self.memory.exists() else self.fold.fresh
        out = []
        for t, nth, value in due:
            memory, result = self.fold.step(memory, t, value)
            out.append((key[0], nth, t, value, *result))
        if due:
            self.memory.update(memory)
            if later:
                self.pending.put(later)
            else:
                self.pending.clear()
        if later:
            self._wake(min(t for t, _, _ in later))
        elif (end := self.fold.until(memory)) is not None:
            if end < now:
                self.memory.clear()
            else:
                self._wake(end + 1)
        if out:
            yield pd.DataFrame(out, columns=[self.by, "fold_nth", "fold_t", "fold_value", *self.names])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Stateful folds need the store that keeps state on disk; a session sets it before its first such stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def fold_stream(stream: DataFrame, fold: Fold, delay: str = "10 minutes", by: str = "user_id", order: str = "event_id", ts: str = "ts", value: str | None = None) -> DataFrame:
    """A stream of (by, order, ts, [value], results): each event with what the fold says of it, once the watermark has passed it.

    Events without a key, an order or a time are left out; those later than `delay` are dropped by the watermark. Events of
    one time go by `order`. ts comes back as a timestamp in the session's zone.
    """
    use_state_store(stream.sparkSession)
    whole = stream.filter(F.col(by).isNotNull() & F.col(ts).isNotNull() & F.col(order).isNotNull()).withColumn("fold_at", F.col(ts).cast("timestamp"))
    rows = whole.withWatermark("fold_at", delay).select(
        F.col(by), "fold_at", F.unix_micros("fold_at").alias("fold_t"), F.col(order).cast("long").alias("fold_nth"), (F.col(value).cast("string") if value else F.lit(None).cast("string")).alias("fold_value")
    )
    schema = f"`{by}` {stream.schema[by].dataType.simpleString()}, fold_nth long, fold_t long, fold_value string, {fold.results}"
    out = rows.groupBy(by).transformWithStateInPandas(statefulProcessor=InOrder(fold, by), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    named = [F.col(by), F.col("fold_nth").alias(order), F.timestamp_micros("fold_t").alias(ts), *([F.col("fold_value").alias(value)] if value else [])]
    return out.select(*named, *(part.split()[0] for part in fold.results.split(", ")))
