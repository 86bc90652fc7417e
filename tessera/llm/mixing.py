"""Mixing sources to target weights by cube-method balanced sampling.

A source's ratio r = target / size says how often its documents are taken: floor(r) times each, and once more with
inclusion probability r - floor(r). The cube method (Deville and Tille; in the fast form of Chauvet and Tille) settles
those probabilities: the flight phase moves three of them at a time along the null-space of two constraints, the token
total and the document total, until one of the three is 0 or 1. A block of any size so ends with at most two fractional
units, and only these go on to the next level. A small landing problem, some units
a source, remains: all its outcomes are tried for the one nearest to the totals.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stash, text_of

NEAR = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: weights repeat over the sources by code point (null last) and share `share` of all sizes.

    No target exceeds most times its source's size; the excess is reshared by weight among the others until none is above.
    If all are at their limit the rest of the total stays unused.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def flight(probability: np.ndarray, amount: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move probabilities until at most two are fractional, keeping sum(p) and sum(p * amount), and each p's expectation.

    draw: numbers in [0, 1), one for each unit. Units are met in the order given.
    """
    p = probability.astype(float).tolist()
    x = amount.astype(float).tolist()
    u = draw.tolist()
    live: list[int] = []
    step = 0
    for i in range(len(p)):
        if not NEAR < p[i] < 1 - NEAR:
            p[i] = float(round(p[i]))
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            d = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if d == (0.0, 0.0, 0.0):
                d = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(live, d, strict=True) if v)
            down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(live, d, strict=True) if v)
            move = up if u[step % len(u)] * (up + down) < down else -down
            step += 1
            for k, v in zip(live, d, strict=True):
                p[k] += move * v
                if p[k] < NEAR or p[k] > 1 - NEAR:
                    p[k] = float(round(p[k]))
            live = [k for k in live if 0.0 < p[k] < 1.0]
            if len(live) == 3:  # rounding kept all three: settle the nearest
                k = min(live, key=lambda k: min(p[k], 1 - p[k]))
                p[k] = float(round(p[k]))
                live.remove(k)
    return np.array(p)


def landing(probability: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """Settle the at most few fractional units by trying all outcomes: nearest token total, then nearest count."""
    p = probability.copy()
    live = np.flatnonzero((p > 0) & (p < 1))
    if len(live):
        want, units = (p[live] * amount[live]).sum(), p[live].sum()
        picks = (np.arange(1 << len(live))[:, None] >> np.arange(len(live)) & 1).astype(float)
        miss, odd = np.abs(picks @ amount[live] - want), np.abs(picks.sum(1) - units)
        p[live] = picks[np.lexsort((odd, miss.round(6)))[0]]
    return p


def settle_all(probability: np.ndarray, amount: np.ndarray, draw: np.ndarray, spare: int = 12) -> np.ndarray:
    """Flight of all units but `spare` ones of evenly spread amounts, then the landing of these and what the flight left.

    A large unit that stays fractional to the end could not be settled near the total by itself; the spare units make up.
    """
    open_units = np.flatnonzero((probability > NEAR) & (probability < 1 - NEAR))
    by_amount = open_units[np.argsort(amount[open_units], kind="stable")]
    held = by_amount[np.unique(np.linspace(0, len(by_amount) - 1, min(spare, len(by_amount))).astype(int))]
    fly = np.setdiff1d(np.arange(len(probability)), held)
    p = probability.astype(float).copy()
    p[fly] = flight(p[fly], amount[fly], draw[fly])
    return landing(p, amount)


def _draws(hashes: np.ndarray, level: int) -> np.ndarray:
    """Numbers in [0, 1) from stable hashes, other ones at each level."""
    z = hashes.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 4096) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken = size * copies.

    size is the number of words. Decisions depend on ids, sources and sizes alone, so reruns agree.

    * null text: size 0, taken 0; null source: a source of its own, last; null id: an id like any other;
    * rows that repeat id, source and size are one unit: all are taken equally often;
    * a source without words has target 0; empty input: no rows. Other columns are not read.

    Blocks of about `block` units settle alone; their at most two leftovers meet in blocks of the next level, until one
    block a source is left. The driver holds one line a source and nothing that grows with the documents.
    """
    spark = docs.sparkSession
    rows = stash(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size")), "sizes")
    per = {r["source"]: (r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    goal = targets({s: v[0] for s, v in per.items()}, weights, share, most)
    facts = [(s, v[0], float(goal[s]), int(goal[s] // v[0]) if v[0] else 0, (goal[s] / v[0]) % 1.0 if v[0] else 0.0, ceil(v[1] / block)) for s, v in per.items()]
    shape = docs.select(F.col(source_col).alias("s")).schema.add("source_size", "long").add("target", "double").add("whole", "integer").add("part", "double").add("blocks", "integer")
    plan = spark.createDataFrame(facts, shape)

    same = F.col("source").eqNullSafe(F.col("s"))
    units = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")).join(plan, same).drop("s")
    units = units.withColumn("h", F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), "doc_id", "size"))
    open_rows = units.select(F.col("doc_id").cast("string").alias("d"), "source", "size", F.col("h"), (F.col("size") * F.col("m")).alias("amount"), F.col("part").alias("p"), F.pmod(F.col("h"), F.col("blocks")).cast("int").alias("block"))
    schema = open_rows.schema

    def settle(level: int, last: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "amount"], kind="stable")
            move = settle_all if last else flight
            return pdf.assign(p=move(pdf["p"].to_numpy(), pdf["amount"].to_numpy(), _draws(pdf["h"].to_numpy(), level + zlib.crc32(str(key).encode()))))

        return run

    settled, level, blocks = None, 0, max([x[5] for x in facts], default=1)
    while True:
        last = blocks <= 1
        now = stash(open_rows.groupBy("source", "block").applyInPandas(settle(level, last), schema), f"flight-{level}")
        done = now.filter("p <= 0 OR p >= 1")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        blocks = ceil(2 * blocks / block)
        open_rows = now.filter("p > 0 AND p < 1").withColumn("block", F.pmod(F.col("h"), F.lit(blocks)).cast("int"))
        level += 1
    chosen = settled.select("d", F.col("source").alias("c"), F.col("size").alias("z"), F.round("p").cast("int").alias("extra"))
    keys = F.col("doc_id").cast("string").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("c")) & (F.col("size") == F.col("z"))
    out = rows.join(chosen, keys).join(plan, same)
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return out.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
