"""States of requests: legal moves, their replay, working memory and confirmed facts of sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Each state and the states that may follow it; none after the last of a request.
MOVES = {
    "RECEIVED": ("NORMALIZED",),
    "NORMALIZED": ("CONTEXT_RESOLVED",),
    "CONTEXT_RESOLVED": ("ANALYZED",),
    "ANALYZED": ("ROUTED",),
    "ROUTED": ("CLARIFYING", "PLANNING", "RETRIEVING", "TOOL_CALLING", "RESPONDING"),
    "CLARIFYING": ("RECEIVED", "FAILED"),
    "PLANNING": ("RETRIEVING",),
    "RETRIEVING": ("EVIDENCE_ASSEMBLING",),
    "TOOL_CALLING": ("RETRIEVING", "EVIDENCE_ASSEMBLING"),
    "EVIDENCE_ASSEMBLING": ("EVIDENCE_VALIDATING",),
    "EVIDENCE_VALIDATING": ("GENERATING", "RETRIEVING", "REFUSING"),
    "GENERATING": ("ANSWER_VALIDATING",),
    "ANSWER_VALIDATING": ("RESPONDING", "RETRYING", "REFUSING"),
    "RETRYING": ("RETRIEVING", "GENERATING"),
    "RESPONDING": (),
    "REFUSING": ("RESPONDING",),
    "FAILED": (),
}
STATES = tuple(MOVES)


def verdict(before: Column, after: Column, moves: dict[str, tuple[str, ...]] = MOVES) -> Column:
    """ok, terminal (nothing follows `before`), illegal, or unknown for a state that is none."""
    allowed = F.element_at(F.create_map(*(x for k, v in moves.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>")))), before)
    return F.when(allowed.isNull() | ~after.isin(*moves), "unknown").when(F.size(allowed) == 0, "terminal").when(F.array_contains(allowed, after), "ok").otherwise("illegal")


def check_moves(log: DataFrame, by: str, order: str, state: str = "state") -> DataFrame:
    """log with the state before and the verdict on the move; the first of a key has neither. One sort, no join."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(order))
    return log.withColumn("before", before).withColumn("verdict", F.when(F.col("before").isNotNull(), verdict(F.col("before"), F.col(state))))


def replay(attempts: DataFrame, by: str, order: str, state: str = "state", first: str = "RECEIVED", moves: dict[str, tuple[str, ...]] = MOVES) -> DataFrame:
    """attempts with the state that each leaves the machine in and whether it was accepted: a move that is not legal changes nothing.

    Attempts are dealt by key and streamed in order; a task holds one state. Rows without a key are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, first
        for b in batches:
            left, ok = [], []
            for k, want in zip(b[by].tolist(), b[state].tolist(), strict=True):
                if k != key:
                    key, now = k, first
                legal = want in moves.get(now, ())
                now = want if legal else now
                left.append(now)
                ok.append(legal)
            yield b.assign(after=left, accepted=ok)

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in attempts.schema)}, after string, accepted boolean"
    return attempts.filter(F.col(by).isNotNull()).repartition(F.col(by)).sortWithinPartitions(by, order).mapInPandas(run, schema)


def working_memory(mentions: DataFrame, by: str, order: str, kind: str, value: str, turn: str) -> DataFrame:
    """(by, kind, seen, last_turn): what a session has mentioned of each kind, each value once in the order of its first mention."""
    first = mentions.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(by, kind, value).agg(F.min(order).alias("_first"))
    seen = first.groupBy(by, kind).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias("seen"))
    last = mentions.groupBy(by).agg(F.max(turn).alias("last_turn"))
    return seen.join(last, by)


def facts_of(facts: DataFrame, session: object = None, kind: str | None = None) -> DataFrame:
    """Confirmed facts(session_id, fact_type, content, created), oldest first; of a session, of a type, or of both."""
    for column, wanted in (("session_id", session), ("fact_type", kind)):
        if wanted is not None:
            facts = facts.filter(F.col(column) == F.lit(wanted))
    return facts.orderBy("created", "session_id", "content")
